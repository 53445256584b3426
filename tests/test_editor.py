import pytest
from pyspark.sql import functions as F

from lakewright.apex import editor, types
from lakewright.apex.bind import Program
from lakewright.sources import metadata
from lakewright.streaming.incremental import Incremental, dirty, newest, start

A = """public virtual class A {
    /** Says hello. */
    public virtual String hi(String who, Integer times) {
        Integer n = times;
        return who + n;
    }
}
"""
B = """@isTest
public class B extends A {
    public override String hi(String who, Integer times) { return who; }
    static void check() {
        A a = new A();
        a.hi('x', 2);
        String who = 'y';
        a.hi(who, 3);
    }
}
"""


@pytest.fixture(scope="module")
def program(spark):
    return Program(spark.createDataFrame([("A.cls", A), ("B.cls", B)], "path string, text string"))


def test_positions(spark, program):
    at = spark.createDataFrame([("B.cls", B.index("a.hi") + 2)], "path string, offset int")
    assert [(r["target_path"], r["name_start"]) for r in editor.definition(program, at).collect()] == [("A.cls", A.index("hi("))]
    assert "public virtual String hi(String who, Integer times)\n/** Says hello. */" in [r["text"] for r in editor.hover(program, at).collect()]
    assert editor.references(program, at).count() == 3
    inside = spark.createDataFrame([("A.cls", A.index("return")), ("A.cls", 0)], "path string, offset int")
    names = {r["id"]: r["name"] for r in program.symbols.collect()}
    assert {r["offset"]: names.get(r["id"]) for r in editor.enclosing_callable(program, inside).collect()} == {A.index("return"): "hi", 0: None}
    chain = editor.selection_chain(program, inside.limit(1)).collect()
    assert len(chain) > 3 and all(a["end"] - a["start"] <= b["end"] - b["start"] for a, b in zip(chain, chain[1:]))


def test_views(spark, program):
    assert {(r["path"], r["start_line"], r["end_line"]) for r in editor.folding_ranges(program).collect()} >= {("A.cls", 1, 7), ("A.cls", 3, 6)}
    assert [r["name"] for r in editor.test_lenses(program).collect()] == ["B"]
    assert editor.dispatch(program).count() == 1
    hints = {(r["path"], r["name"]) for r in editor.inlay_hints(program).collect()}
    assert hints == {("B.cls", "who"), ("B.cls", "times")} and editor.inlay_hints(program).count() == 3
    b = program.symbols.where("name = 'B'").first()["id"]
    assert [(r["name"], r["tier"]) for r in editor.member_candidates(program, b).collect()] == [("check", 0), ("hi", 0)]
    hi = program.symbols.where("name = 'hi' and path = 'A.cls'").first()["id"]
    edits = {r["new_text"] for r in editor.reorder_parameters(program, hi, [1, 0]).collect()}
    assert edits == {"Integer times, String who", "2, 'x'", "3, who"}
    toks = editor.semantic_tokens(program)
    assert toks.count() == toks.select("path", "start").distinct().count() and toks.where("gap < 0").count() == 0


@pytest.mark.parametrize("param,arg,want", [
    ("Decimal", "Integer", True), ("Integer", "Decimal", False), ("String", "Id", True), ("Datetime", "Date", True), ("Date", "Datetime", False), ("Object", "Foo", True), ("Foo", "Object", None),
    ("String", "Integer", False), ("SObject", "Account", True), ("Account", "SObject", None), ("Account", "Contact", False), ("Base", "Derived", True), ("Derived", "Base", False), ("List<SObject>", "List<Account>", True),
    ("List<Integer>", "List<String>", False), ("Set<String>", "Set<String>", True), ("Iterable<String>", "List<String>", True), ("Unknown", "Integer", None), ("String", None, None), ("Map<Id, X>", "Map<Id, X>", True),
])
def test_compatibility(param, arg, want):
    assert types.compatible(param, arg, {"derived": {"base"}, "base": set()}, {"account", "contact"}) is want


def test_type_rules():
    assert types.split_generic("Map<Id, List<X>>[]") == ("List", ["Map<Id, List<X>>"])
    assert types.widen("Integer", "Decimal") == "Decimal" and types.widen("String", "Integer") is None
    assert types.pick_overload([["Object"], ["String"], ["String", "String"]], ["String"]) == [1]
    assert types.pick_overload([["Integer"], ["String"]], [None]) == [0, 1]
    assert types.element_type("Map", ["Id", "X"], "values") == "List<X>" and types.binary_type("+", "Integer", "String") == "String"
    assert types.parse_signature("public static Integer go(Map<Id, X> a, String b)", "go", 2) == ("Integer", ["Map<Id, X>", "String"])


def test_metadata(spark):
    files = spark.createDataFrame([
        ("r/objects/Pay__c/fields/Acc__c.field-meta.xml", "field", "<?xml version='1.0'?><CustomField><fullName>Acc__c</fullName><type>Lookup</type><referenceTo>Account</referenceTo><relationshipName>Payments</relationshipName></CustomField>"),
        ("r/objects/Pay__c/fields/Bad__c.field-meta.xml", "field", "<CustomField><fullName>"),
        ("r/objects/Pay__c/Pay__c.object-meta.xml", "object", "<CustomObject><nameField><label>N</label><type>Text</type></nameField></CustomObject>"),
        ("r/l.labels-meta.xml", "labels", "<CustomLabels><labels><fullName>A</fullName><value>x</value></labels><labels><fullName>B</fullName><value>y</value></labels></CustomLabels>"),
        ("r/P.page", "page", "<apex:page title=\"a>b\" controller=\"Main\" extensions=\"E1, E2\">x</apex:page>"),
    ], "path string, file_class string, text string")
    f = metadata.fields(files)
    assert sorted((r["object"], r["api_name"]) for r in f.collect()) == [("Pay__c", "Acc__c"), ("Pay__c", "Name")]
    assert [tuple(r) for r in metadata.child_relationships(f).collect()] == [("Account", "Payments__r", "Pay__c")]
    assert sorted(r["full_name"] for r in metadata.labels(files).collect()) == ["A", "B"]
    assert sorted(r["class_lc"] for r in metadata.controllers(files).collect()) == ["e1", "e2", "main"]
    assert metadata.with_universal(spark, f).count() == 10
    paths = spark.createDataFrame([("pay__c", "Acc__r"), ("Pay__c", "name"), ("Pay__c", "nope")], "object string, name string")
    assert {(r["name"], r["field"]) for r in metadata.lookup_fields(paths, f).collect()} == {("Acc__r", "acc__c"), ("name", "name"), ("nope", None)}
    o = metadata.objects(files).first()
    assert o["is_custom"] and len(o["fields"]) == 2
    assert [r["t"] for r in spark.createDataFrame([("Picklist",), ("Checkbox",)], "x string").select(metadata.code_type(F.col("x")).alias("t")).collect()] == ["String", None]


def test_versions(spark):
    c = spark.createDataFrame([("a", 2, "new"), ("a", 1, "old"), ("b", 1, None)], "path string, version long, text string")
    assert sorted((r["path"], r["text"]) for r in newest(c).collect()) == [("a", "new"), ("b", None)]
    known = spark.createDataFrame([("a", 1, "same"), ("b", 5, "x")], "path string, version long, text string")
    more = spark.createDataFrame([("a", 2, "same"), ("b", 4, "late"), ("c", 1, "y")], "path string, version long, text string")
    assert [r["path"] for r in dirty(known, more).collect()] == ["c"]


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def put(name, rows):
        spark.createDataFrame(rows, "path string, version long, text string").coalesce(1).write.mode("append").json(str(src))

    put("1", [("A.cls", 1, A), ("B.cls", 1, B)])
    state = Incremental(spark)
    q = start(spark.readStream.schema("path string, version long, text string").json(str(src)), state, str(tmp_path / "cp"), "100 milliseconds")
    q.processAllAvailable()
    assert state.rebinds == 1 and state.symbols.where("name = 'hi'").count() == 2
    put("2", [("B.cls", 2, B.replace("'y'", "'z'"))])
    q.processAllAvailable()
    assert state.rebinds == 1
    put("3", [("B.cls", 3, None), ("A.cls", 0, "class Old { }")])
    q.processAllAvailable()
    q.stop()
    assert state.rebinds == 2 and state.files.where("text is not null").count() == 1 and state.symbols.where("path = 'B.cls'").count() == 0 and state.symbols.where("name = 'Old'").count() == 0
    # a new process goes on from the last batch's state, and binds without parsing
    again = Incremental(spark, state.folder)
    assert again.version == state.version and again.rebinds == 2 and again.symbols.where("name = 'hi'").count() == 1
    assert again.program.refs.where("target_id is not null").count() == state.program.refs.where("target_id is not null").count() > 0
    put("4", [("C.cls", 1, "public class C { void go(A a) { a.hi('q', 1).length(); } }"), ("B.cls", 2, "class Late { }")])
    q = start(spark.readStream.schema("path string, version long, text string").json(str(src)), again, str(tmp_path / "cp"), "100 milliseconds")
    q.processAllAvailable()
    q.stop()
    assert again.rebinds == 3 and again.symbols.where("name = 'Late'").count() == 0
    assert again.program.refs.where("path = 'C.cls' and name = 'hi' and outcome = 'Resolved'").count() == 1
