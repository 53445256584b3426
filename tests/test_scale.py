"""Steps that grow with a corpus: what they broadcast, deal out and hold at once."""

import pyarrow as pa

from lakewright import source_queries
from lakewright.apex import corpus
from lakewright.apex.bind import Program
from lakewright.apex.editor import folding_ranges
from lakewright.apex.facts import of_file
from lakewright.operators import relations


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_are_found_without_a_broadcast(spark):
    docs = spark.createDataFrame([("a", "x\né\n\nz"), ("b", ""), (None, "q")], "path string, text string")
    points = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("a", 4), ("a", 6), ("a", 7), ("a", 8), ("b", 0), ("b", 1), ("c", 0), (None, 0), ("a", None)], "path string, offset int")
    got = relations.line_col(points, relations.line_table(docs, "path", "text"), "path")
    assert "Broadcast" not in plan(got)
    want = [("a", 0, 1, 1), ("a", 1, 1, 2), ("a", 2, 2, 1), ("a", 4, 2, 3), ("a", 6, 4, 1), ("a", 7, 4, 2), ("a", 8, None, None), ("b", 0, 1, 1), ("b", 1, None, None), ("c", 0, None, None), (None, 0, None, None), ("a", None, None, None)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert got.dtypes[2:] == [("line", "int"), ("col", "bigint")]


def test_places_of_the_query_are_not_broadcast(spark, sf_dir):
    assert "Broadcast" not in plan(source_queries.source_places(spark, sf_dir))


def test_few_files_are_held_at_once():
    b = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(10)]), pa.array(["x"] * 10)], names=["path", "text"])
    got = list(corpus.bounded(iter([b]), lambda p, t: [(p,)] * (corpus.BATCH_ROWS // 2), len))
    assert [[p for p, _ in g] for g in got] == [["0", "1", "2"], ["3", "4", "5"], ["6", "7", "8"], ["9"]]


def test_tasks_grow_with_the_files(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(source_queries, "TASK_FILES", 10)
    n = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    assert source_queries.source_files(spark, sf_dir).rdd.getNumPartitions() == n // 10 + 1
    assert source_queries.dealt_parts(spark, sf_dir).count() == n


def test_errors_parse_each_file_once(spark, sf_dir):
    p = plan(source_queries.source_errors(spark, sf_dir))
    assert p.count("MapInArrow") == 1 and "Join" not in p


NESTED = "public class A { class In { void f() { } } In one; B.In two; In.Deep three; }"


def test_only_what_is_asked_for_is_parsed(spark):
    files = spark.createDataFrame([("a", NESTED), ("b", "class B { class In { class Deep { } } }")], "path string, text string")
    p = Program(files)
    folding_ranges(p).collect()
    assert p._facts is None
    only = Program(files, only=("symbols",))
    assert only.symbols.count() == Program(files).symbols.count() and only._facts is None
    assert not of_file("a", NESTED, ("symbols",)).get("uses") and of_file("a", NESTED)["uses"]


def test_owners_and_nested_types(spark):
    # the name of a nested type means the one in the class itself, before any other
    files = spark.createDataFrame([("a", NESTED), ("b", "class B { class In { class Deep { } } }"), ("in", "class In { }"), ("c", "class C { In x; }")], "path string, text string")
    p = Program(files)
    o = {r["id"]: (r["type_id"], r["top_id"]) for r in p.owner.collect()}
    ids = {(r["path"], r["name"], r["kind"]): r["id"] for r in p.symbols.collect()}
    assert o[ids["a", "f", "Method"]] == (ids["a", "In", "Class"], ids["a", "A", "Class"])
    assert o[ids["b", "Deep", "Class"]] == (ids["b", "Deep", "Class"], ids["b", "B", "Class"])
    got = {(r["path"], r["name"]): r["target_id"] for r in p.refs.where("kind = 'type'").collect()}
    assert got["a", "In"] == ids["a", "In", "Class"] and got["c", "In"] == ids["in", "In", "Class"]
    assert got["a", "B.In"] == ids["b", "In", "Class"] and got["a", "In.Deep"] == ids["b", "Deep", "Class"]


def test_hot_keys_meet_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(relations, "FEW", 1)
    monkeypatch.setattr(relations, "HOT", 5)
    left = spark.createDataFrame([("hot", i) for i in range(20)] + [("x", 20), ("y", 21), ("none", 22), (None, 23)], "k string, i int")
    right = spark.createDataFrame([("hot", "a"), ("x", "b"), ("x", "c"), ("y", "d"), ("unused", "e"), (None, "f")], "k string, v string")
    got = relations.lookup(left, right, ["k"])
    assert "BroadcastHashJoin" in plan(got)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").collect()))
    outer = relations.lookup(left, right, ["k"], "left")
    assert sorted(map(str, outer.collect())) == sorted(map(str, left.join(right, "k", "left").collect()))
