from lakewright.__main__ import main, project_root
from lakewright.apex.dynamic import dynamic_queries
from lakewright.apex.fix import apply_edits, fix
from lakewright.sources import docs


def test_edits(spark):
    files = spark.createDataFrame([("a.cls", "class É { int x; }"), ("b.cls", "class B { }"), ("c.cls", "class C { }")], "path string, text string")
    edits = spark.createDataFrame([("a.cls", 11, 17, "Long y;"), ("a.cls", 11, 14, "inner"), ("b.cls", 0, 5, "klass"), ("c.cls", 0, 7, "x"), ("c.cls", 5, 9, "y")], "path string, start int, end int, new_text string")
    got = {r["path"]: (r["status"], r["text"]) for r in apply_edits(files, edits).collect()}
    assert got == {"a.cls": ("changed", "class É { Long y; }"), "b.cls": ("refused", "class B { }"), "c.cls": ("refused", "class C { }")}


def test_fix_to_the_end(spark):
    src = "public class A { public void go() { live(); }\n private void live() { }\n private void one() { two(); }\n private void two() { } }"
    user = "public class U { void f() { new A().go(); } public static void main() { U.main(); new U().f(); } }"
    files, passes = fix(spark.createDataFrame([("A.cls", src), ("U.cls", user)], "path string, text string"))
    got = {r["path"]: r["text"] for r in files.collect()}
    assert passes == 2 and "one" not in got["A.cls"] and "two" not in got["A.cls"] and "live()" in got["A.cls"] and got["U.cls"] == user


def test_dynamic_binds(spark):
    src = "class A { void f(Id k) { String q = 'SELECT Id FROM X WHERE a = :k'; q += ' AND b IN :others'; Database.query(q); Database.countQuery('SELECT COUNT() FROM X WHERE c = :me'); Database.insert(x); } }"
    got = dynamic_queries(spark.createDataFrame([("A.cls", src)], "path string, text string")).collect()
    assert [(r["method"], r["binds"]) for r in got] == [("query", "others"), ("countQuery", "me")]


def test_reference_pages(spark):
    html = "<h1>Thing Class</h1><h2>Thing Methods</h2><h3>go(a)</h3><code>public Integer go(String a)</code><h3>stop()</h3><pre>void stop()</pre><a href='/x/one.html'>1</a><a href='y/one'>2</a><table><tr><th>Field</th><th>Type</th></tr><tr><td>Name</td><td>string</td></tr></table>"
    pages = spark.createDataFrame([("p", "Thing Class", html), ("q", "broken", "<h2>x<td"), ("r", None, None)], "page_id string, title string, html string")
    assert [(r["class_name"], r["member"], r["kind"]) for r in docs.class_members(pages).collect()] == [("Thing", "go", "method"), ("Thing", "stop", "method")]
    assert [(r["field"], r["field_type"]) for r in docs.object_fields(pages).collect()] == [("Name", "string")]
    assert [r["slug"] for r in docs.links(pages).collect()] == ["one"]
    members = spark.createDataFrame([("m1", "m1", "go", "method", "x"), ("p", "Thing", "stop", "method", "y")], docs.MEMBERS)
    parents = spark.createDataFrame([("m1", "mid"), ("mid", "p")], "child string, parent string")
    classes = spark.createDataFrame([("p", "Thing")], "page_id string, class_name string")
    assert {r["class_name"] for r in docs.reattach(members, parents, classes).collect()} == {"Thing"}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "A.cls").write_text("public class A {\n  void f() { g(1); }\n}")
    monkeypatch.setattr("lakewright.__main__.session", lambda: spark)
    assert main(["query", "g($x)", str(tmp_path)]) == 0
    assert capsys.readouterr().out.strip().endswith("A.cls:2:14:g(1)")
    assert main(["query", "g($x)", str(tmp_path), "-r", "h($x, $x)"]) == 0
    assert "h(1, 1)" in (tmp_path / "A.cls").read_text()
    assert main(["query", "g(", str(tmp_path)]) == 2 and main(["query", "x", str(tmp_path / "nope")]) == 2
    assert project_root(str(tmp_path)) is None
    (tmp_path / "sfdx-project.json").write_text("{}")
    assert project_root(str(tmp_path)) == str(tmp_path)
