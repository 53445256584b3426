import pytest
from pyspark.sql import functions as F

from lakewright.apex import diagnostics, editor
from lakewright.apex.bind import Program
from lakewright.apex.fix import apply_edits, fix

MODEL = """public virtual class Node {
    public Node next;
    protected String label;
    private Integer secret;
    public List<Node> kids;
    public Map<String, Leaf> byName;
    public virtual Node step() { return next; }
    public String show(String s) { return s; }
    public String show(Integer n) { return 'n'; }
    public String show(Node n) { return 'node'; }
    public String show(Object o) { return 'o'; }
}
"""
LEAF = """public class Leaf extends Node {
    public Integer size;
    public override Node step() { return this; }
    public Leaf grow() { return this; }
    public Leaf() { this(1); }
    public Leaf(Integer n) { super(); size = n; }
}
"""
USE = """public class Use {
    private Leaf held;
    public void go(Leaf leaf, Node node) {
        leaf.grow().grow().step().step();
        node.kids.get(0).step();
        node.byName.get('a').grow();
        for (Leaf one : node.byName.values()) { one.grow(); }
        held.grow().size.intValue();
        leaf.show('x');
        leaf.show(1);
        leaf.show(leaf);
        leaf.show(true);
        leaf.secret = 2;
        String t = 'a'.toUpperCase().trim();
        Leaf made = new Leaf();
    }
}
"""


@pytest.fixture(scope="module")
def program(spark):
    files = spark.createDataFrame([("Node.cls", MODEL), ("Leaf.cls", LEAF), ("Use.cls", USE)], "path string, text string")
    library = spark.createDataFrame([("string", "touppercase", 0, "String"), ("string", "trim", 0, "String"), ("integer", "intvalue", 0, "Integer"), ("comparable", "compareto", 1, "Integer")], "class_lc string, name_lc string, arity int, return_type string")
    return Program(files, library=library)


def targets(p, line, name):
    """(type, member, parameters) of what name means on a line of Use.cls."""
    at = sum(len(x) + 1 for x in USE.split("\n")[: line - 1])
    end = at + len(USE.split("\n")[line - 1])
    r = p.refs.where(f"path = 'Use.cls' and name = '{name}' and start >= {at} and start < {end}")
    s = p.symbols.select(F.col("id").alias("target_id"), F.col("name").alias("n"), "params", "container_id")
    own = p.symbols.select(F.col("id").alias("container_id"), F.col("name").alias("type"))
    return [tuple(x) for x in r.join(s, "target_id", "left").join(own, "container_id", "left").orderBy("start").select("type", "n", "params", "outcome").collect()]


def test_chains_take_the_declared_types(program):
    assert [t[0] for t in targets(program, 4, "grow")] == ["Leaf", "Leaf"]
    assert [t[0] for t in targets(program, 4, "step")] == ["Leaf", "Node"]
    assert targets(program, 5, "step") == [("Node", "step", "", "Resolved")]
    assert targets(program, 6, "grow")[0][0] == "Leaf" and targets(program, 7, "grow")[0][0] == "Leaf"
    assert targets(program, 8, "grow")[0][0] == "Leaf" and targets(program, 8, "size")[0][0] == "Leaf"
    assert targets(program, 8, "intValue") == [(None, None, None, "Library")]
    assert [t[3] for t in targets(program, 14, "trim")] == ["Library"]


def test_overloads_are_narrowed_by_argument_types(program):
    assert targets(program, 9, "show") == [("Node", "show", "String", "Resolved")]
    assert targets(program, 10, "show") == [("Node", "show", "Integer", "Resolved")]
    assert targets(program, 11, "show") == [("Node", "show", "Node", "Resolved")]
    assert targets(program, 12, "show") == [("Node", "show", "Object", "Resolved")]


def test_private_members_are_not_inherited(program):
    assert targets(program, 13, "secret")[0][3] == "Unresolved"
    why = {r["why"] for r in diagnostics.unresolved_kinds(program).collect()}
    assert "no such member" in why


def test_constructors_and_dead_code(program):
    dead = {(r["message"]) for r in diagnostics.dead_code(program).collect()}
    assert not any("constructor" in m for m in dead)
    ids = {r["id"] for r in program.symbols.where("name = 'Leaf' and kind = 'Constructor' and arity = 1").collect()}
    assert program.refs.where("kind = 'constructor'").where(F.col("target_id").isin(*ids)).count() == 1


def test_expression_types(program):
    got = {(r["path"], r["type_text"]) for r in editor.expression_types(program).collect()}
    assert {("Use.cls", "Leaf"), ("Use.cls", "Node"), ("Use.cls", "List<Node>"), ("Use.cls", "Map<String, Leaf>"), ("Use.cls", "List<Leaf>")} & got >= {("Use.cls", "Leaf"), ("Use.cls", "Node"), ("Use.cls", "List<Node>")}


def test_rename(program):
    ids = {(r["path"], r["name"], r["kind"]): r["id"] for r in program.symbols.collect()}
    step = ids["Node.cls", "step", "Method"]
    assert program.family(step).count() == 2
    edits = program.rename_edits(step, "advance")
    out = {r["path"]: r["text"] for r in apply_edits(program.files, edits).collect()}
    assert "advance().advance()" in out["Use.cls"] and "override Node advance()" in out["Leaf.cls"] and "step" not in "".join(out.values())
    assert program.rename_refusal(step, "grow") and program.rename_refusal(step, "class") and program.rename_refusal(step, "2x") and program.rename_refusal("none", "x")
    assert program.rename_refusal(ids["Use.cls", "leaf", "Parameter"], "node") and program.rename_refusal(ids["Use.cls", "held", "Field"], "made")
    assert program.rename_refusal(ids["Use.cls", "held", "Field"], "kept") is None
    typed = {r["path"]: r["text"] for r in apply_edits(program.files, program.rename_edits(ids["Leaf.cls", "Leaf", "Class"], "Twig")).collect()}
    assert "public Twig() { this(1); }" in typed["Leaf.cls"] and "new Twig()" in typed["Use.cls"]
    with pytest.raises(ValueError):
        program.rename_edits(ids["Leaf.cls", "Leaf", "Class"], "Node")


def test_visible_members(program):
    ids = {(r["path"], r["name"]): r["id"] for r in program.symbols.where("kind = 'Class'").collect()}
    names = lambda a, b: {r["name"] for r in editor.visible_candidates(program, ids[a], ids[b]).collect()}
    node, leaf, use = ("Node.cls", "Node"), ("Leaf.cls", "Leaf"), ("Use.cls", "Use")
    assert "secret" in names(node, node) and "secret" not in names(node, leaf)
    assert "label" in names(node, leaf) and "label" not in names(node, use) and "kids" in names(node, use)
    assert {r["name"] for r in editor.library_candidates(program, "String").collect()} == {"touppercase", "trim"}


def test_declarators_go_alone(spark):
    text = "public class A {\n    public Integer go() {\n        Integer a = 1, b = 2, c = 3;\n        Integer x, y;\n        return b;\n    }\n    private Integer p, q;\n    public Integer z() { return q + go(); }\n}\n"
    use = "@isTest public class B { Integer r() { return new A().z(); } }"
    out, _ = fix(spark.createDataFrame([("A.cls", text), ("B.cls", use)], "path string, text string"))
    a = {r["path"]: r["text"] for r in out.collect()}["A.cls"]
    assert "Integer b = 2;" in a and "Integer x" not in a and "Integer q;" in a and "return b" in a


def test_platform_members_live(spark):
    files = [("J.cls", "public class J implements Database.Batchable<SObject>, Comparable { public void start() { } public Integer compareTo(Object o) { return 0; } public void spare() { } }"), ("P.cls", "public class P { public String title() { return 'x'; } }")]
    p = Program(spark.createDataFrame(files, "path string, text string"), controllers=spark.createDataFrame([("p",)], "class_lc string"))
    assert {r["message"] for r in diagnostics.dead_code(p).collect()} == {"method 'spare' is never used"}
    j = p.symbols.where("name = 'compareTo'").first()["id"]
    assert p.rename_refusal(j, "rank") == "the platform calls it by this name"
