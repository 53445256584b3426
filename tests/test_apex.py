import pytest
from pyspark.sql import functions as F

from lakewright.apex import corpus, diagnostics
from lakewright.apex.bind import Program
from lakewright.apex.parser import parse, parse_fragment
from lakewright.apex.pattern import Pattern
from lakewright.functions.text import PatternError

BASE = """public virtual class Base {
    protected Integer count;
    public virtual void run(String s) { helper(s); }
    private void helper(String s) { System.debug(s); }
    private void unused() { return; }
}
"""
DERIVED = """public class Derived extends Base implements Shape {
    public Integer area;
    public override void run(String s) {
        Base b = new Base();
        b.run(s);
        for (Account a : [SELECT Id, Nme FROM Account WHERE Name = :s]) {
            update a;
            List<Contact> c = [SELECT Id FROM Contact WHERE AccountId = :a.Id];
            Database.insert(c);
        }
        Integer bad = 'text';
        count = 1;
        return;
        System.debug('é never ' + count);
    }
}
"""
SHAPE = "public interface Shape { Decimal size(Integer scale); }\n"
BROKEN = "public class Broken { void f() { Integer x = ; } public public Integer y; }\n"
TRIGGER = "trigger T on Account (before insert, after update) { new Derived().run('x'); }\n"


@pytest.fixture(scope="module")
def files(spark):
    rows = [("p/Base.cls", BASE), ("p/Derived.cls", DERIVED), ("p/Shape.cls", SHAPE), ("p/Broken.cls", BROKEN), ("p/T.trigger", TRIGGER)]
    return spark.createDataFrame(rows, "path string, text string").cache()


@pytest.fixture(scope="module")
def program(spark, files):
    schema = spark.createDataFrame([("Account", "Id"), ("Account", "Name"), ("Contact", "Id"), ("Contact", "AccountId")], "object string, field string")
    return Program(files, schema)


@pytest.mark.parametrize("src", ["a + b * c", "x = y ?? z", "(String) a.b", "a ? b : c ? d : e", "new Map<Id, List<X>>{ a => b }", "i >>> 2 > 1", "[SELECT Id, (SELECT Id FROM Kids) FROM A WHERE x IN :ids AND (y = 1 OR z LIKE 'q%') ORDER BY x DESC NULLS LAST LIMIT 5]", "List<String>.class", "a?.b()[0].c++", "x instanceof Foo.Bar"])
def test_expressions_parse(src):
    assert parse_fragment(src, "Expression") is not None


def test_parse_is_lossless_and_never_fails(files, spark):
    t = parse(BROKEN)
    assert t.errors and "".join(x.text for x in t.tokens) == BROKEN
    back = {r["path"]: r["text"] for r in corpus.render(corpus.token_rows(files)).collect()}
    assert back["p/Derived.cls"] == DERIVED and back["p/Broken.cls"] == BROKEN
    n = corpus.nodes(files)
    assert n.where("kind = 'SoqlExpr'").count() == 2
    assert n.alias("c").join(n.alias("p"), F.expr("c.path = p.path and c.parent_id = p.node_id and (c.start < p.start or c.end > p.end)")).count() == 0


def hits(files, *a, **k):
    return [(r["path"], r["line"], r["col"], r["text"], r["binds"]) for r in corpus.ordered(corpus.search(files, *a, **k)).collect()]


def one(spark, text, *a, **k):
    return hits(spark.createDataFrame([("a.cls", text)], "path string, text string"), *a, **k)


def test_search_deep_block_and_focus(files, spark):
    got = hits(files, "for (...) { ... ^[SELECT ... FROM $o ...] ... }")
    assert [(g[1], g[4]["o"]) for g in got] == [(8, "Contact")]
    assert hits(files, "for (...) { ... update $x; ... }")[0][4]["x"] == "a"
    src = "class A { void f() { if (a) { p(); } q(); } void g() { q(); p(); } }"
    assert len(one(spark, src, "{ ... p(); ... q(); ... }")) == 1


def test_search_captures_unify_without_case(spark):
    assert len(one(spark, "class A { void f() { x = X; x = y; } }", "$a = $a")) == 1
    assert len(one(spark, "class A { void f() { Map<A, B> m = new Map<a, b>(); Map<A, B> n = new Map<B, A>(); } }", "Map<$K, $V> $v = new Map<$K, $V>();")) == 1
    assert [h[4]["args"] for h in one(spark, "class A { void f() { g(); g(1); g(1, 2); } }", "g($...args)")] == ["", "1", "1, 2"]
    assert len(one(spark, "class A { void f() { g((h(1)), 2); } }", "g(h(...), ...)")) == 1
    assert len(one(spark, "class A { void f() { String s = 'a'; String t = 'b'; } }", "String $n = '...';")) == 2
    assert {h[4]["OP"] for h in one(spark, "class A { void f() { x = a + b; y = a * c; } }", "a $OP $R")} == {"+", "*"}


def test_search_modifiers_are_a_subset(spark):
    src = "class A { @isTest static void one() { } public void two() { } }"
    assert [h[4]["m"] for h in one(spark, src, "static void $m(...) { ... }")] == ["one"]
    assert [h[4]["m"] for h in one(spark, src, "void $m(...) { ... }")] == ["one", "two"]
    assert [h[4]["f"] for h in one(spark, "class A { private static String s; public Integer n; }", "private $T $f;")] == ["s"]


def test_search_conditions(files, spark):
    assert len(hits(files, "kind:SoqlExpr", nots=["kind:SoqlWhereClause"])) == 0
    assert len(hits(files, "kind:SoqlExpr", ands=["[SELECT ... FROM Contact ...]"])) == 1
    src = "class A { void f(String s, Integer n) { a.addAll(s); a.remove(n); a.get(1); } }"
    assert [h[4]["M"] for h in one(spark, src, "a.$M($x)", ands=["$M ~ {add,remove}*"])] == ["addAll", "remove"]
    assert [h[4]["x"] for h in one(spark, src, "a.$M($x)", ands=["$x : String"])] == ["s"]
    assert [h[4]["M"] for h in one(spark, src, "a.$M($x)", ands=["$M ~ /^[a-z]+$/"])] == ["remove", "get"]
    assert len(one(spark, "class A { /* TODO x */ // done\n }", "comment:TODO")) == 1
    with pytest.raises(PatternError):
        corpus.Search("f($x)", ands=["$y ~ a*"])
    with pytest.raises(PatternError):
        Pattern("f(((")


def test_rewrite(spark):
    def run(text, pattern, replace, **k):
        df = corpus.rewrite(spark.createDataFrame([("a.cls", text)], "path string, text string"), pattern, replace, **k)
        return [(r["status"], r["new_text"]) for r in df.collect()]

    assert run("class A { void f() { g(g(1)); } }", "g($x)", ["h($x)"]) == [("changed", "class A { void f() { h(g(1)); } }")]
    assert run("class A {\n  void f() {\n    log(1);\n    g();\n  }\n}", "log(...);", [""]) == [("changed", "class A {\n  void f() {\n    g();\n  }\n}")]
    assert run("class A { void f() { g(1); } }", "g($x)", ["h($x"])[0][0] == "refused"
    got = run("class A { void f() { List<X> v = [SELECT Id FROM X WHERE a = :b.c]; } }", "$_ $v = ${[${SELECT ... FROM $o ...}]};".replace("${SELECT ... FROM $o ...}", "SELECT ... FROM $o ..."), ["$1 => q('$1:quote', '$o')"])
    assert got == [("changed", "class A { void f() { List<X> v = q('[SELECT Id FROM X WHERE a = :b.c]', 'X'); } }")]
    got = run("class A { void f() { g(a.Id, b); } }", "g($...args)", ["g($n)"], lets=["n = $args ~ $e.Id => $e:id"])
    assert got == [("changed", "class A { void f() { g(a, b); } }")]


def test_program_resolves_across_files(program):
    names = {r["id"]: r["name"] for r in program.symbols.select("id", "name").collect()}
    edges = {(names[r["sub"]], names[r["super"]]) for r in program.edges.collect()}
    assert edges == {("Derived", "Base"), ("Derived", "Shape")}
    refs = {(r["name"], r["kind"]): names.get(r["target_id"]) for r in program.refs.where("outcome = 'Resolved'").collect()}
    assert refs["count", "name"] == "count" and refs["helper", "method"] == "helper" and refs["Derived", "type"] == "Derived"
    calls = {(names[r["caller"]], names[r["callee"]]) for r in program.call_edges().collect()}
    assert ("run", "helper") in calls and ("T", "run") in calls and ("run", "run") in calls


def test_findings(program):
    got = {(r["path"], r["code"], r["message"]) for r in diagnostics.all_findings(program).collect()}
    codes = lambda c: {(p, m) for p, k, m in got if k == c}
    assert ("p/Base.cls", "method 'unused' is never used") in codes("dead")
    assert not any("helper" in m or "'run'" in m for _, m in codes("dead"))
    assert {p for p, _ in codes("syntax")} == {"p/Broken.cls"}
    assert codes("modifier") == {("p/Broken.cls", "duplicate modifier")}
    assert codes("schema") == {("p/Derived.cls", "unknown field 'Nme' on 'Account'")}
    assert sorted(m for _, m in codes("bulk")) == ["DML inside a loop", "a Database call inside a loop", "a query inside a loop"]
    assert codes("unreachable") == {("p/Derived.cls", "unreachable code")}
    assert codes("missing") == {("p/Derived.cls", "method 'size' is not implemented")}
    assert codes("type") == {("p/Derived.cls", "String cannot become Integer")}


def test_rename_and_positions(program, spark):
    target = program.symbols.where("name = 'helper'").first()
    edits = program.rename_edits(target["id"], "aid").collect()
    assert len(edits) == 2
    at = spark.createDataFrame([("p/Base.cls", target["name_start"])], "path string, offset int")
    assert [r["id"] for r in program.symbol_at(at).collect()] == [target["id"]]
    assert {r["name"] for r in program.workspace_symbols("ERI").collect()} == {"Derived"}


def test_files_and_filters(spark, tmp_path):
    for name, text in {"a/X.CLS": "class X { }", "a/.hidden/Y.cls": "class Y { }", "node_modules/Z.cls": "", "b/Q.page": "<apex:page/>", "b/n.txt": "x"}.items():
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    got = corpus.read_files(spark, str(tmp_path))
    assert sorted((r["path"].rsplit("/", 1)[1], r["file_class"]) for r in got.collect()) == [("Q.page", "page"), ("X.CLS", "apex")]
    df = spark.createDataFrame([("r/a/x",), ("r/ab/x",), ("r/a",)], "path string")
    assert sorted(r[0] for r in df.where(corpus.under(F.col("path"), ["r/a"])).collect()) == ["r/a", "r/a/x"]


def test_argument_return_and_type_findings(spark):
    a = "public class A { public class In { } public class Out { } private In x; public Out make() { return null; } public Integer f(String s, Integer n) { In y; return 'no'; } void g() { f(1, 'b'); f('a', 1); } }"
    b = "public class B { void f() { new A().make(); } }"
    p = Program(spark.createDataFrame([("A.cls", a), ("B.cls", b)], "path string, text string"))
    got = sorted((r["code"], r["message"]) for r in diagnostics.type_mismatches(p).unionByName(diagnostics.type_narrowing(p)).collect())
    assert got == [("narrow", "type 'In' can be private"), ("type", "Integer cannot become String"), ("type", "String cannot become Integer")]
    at = {(r["line"], r["col"]) for r in diagnostics.located(p).where("code = 'type'").collect()}
    assert at == {(1, a.index("'no'") + 1), (1, a.index("f(1,") + 3)}


def test_editor_columns():
    text = "aé\U0001f600b\nx"
    lines = corpus.Lines(text)
    assert lines.utf16(text, 3) == (0, 4) and lines.line_col(3) == (1, 8) and lines.utf16(text, 5) == (1, 0)
    assert lines.offset(text, 0, 4) == 3 and lines.offset(text, 0, 99) == 4 and lines.offset(text, 5, 0) is None and lines.offset(text, 0, 7, utf16=False) == 3
