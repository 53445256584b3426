"""Helpers that the operators share: reading, cutting lineage, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import cut, drop, shared_dir

__all__ = ["Carried", "components", "cut", "drop", "ranked", "shared_dir", "spread_join", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the test data; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Carried:
    """Columns of a table under names that clash with none of an operator's."""

    def __init__(self, df: DataFrame, *own: str):
        self.names = df.columns
        self.own = {n.lower(): n for n in own}
        self.alias = {n: f"__carried_{i}" for i, n in enumerate(self.names) if n.lower() not in self.own}

    def keep(self) -> list:
        return [F.col(f"`{n}`").alias(a) for n, a in self.alias.items()]

    def restore(self, df: DataFrame, **values: str) -> DataFrame:
        """The table's columns; values names the columns that stand for its own."""
        return df.select(*(F.col(self.alias[n] if n in self.alias else values.get(n.lower(), n)).alias(n) for n in self.names))


#: Keys that take more than 1 / HOT of all rows are at most HOT many.
HOT = 512


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left joined with right, whose keys are unique. Keys that take more than 1 / HOT
    of left's rows are HOT at most; their rows of right are broadcast, and left's rows
    of them stay where they are. left is read three times and should be a table."""
    counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    hot = counts.where(F.col("__n") > max(64, left.count() // HOT)).select(*on, F.lit(True).alias("__hot"))
    told = left.join(F.broadcast(hot), on, "left")
    much = told.where("__hot").drop("__hot").join(F.broadcast(right.join(F.broadcast(hot.drop("__hot")), on, "left_semi")), on, how)
    return much.unionByName(told.where("__hot is null").drop("__hot").join(right, on, how))


def ranked(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df with the 1-based number of a row within its group, by order. Rows are dealt
    by range of group and order, equal ones apart, so a group of any size is split;
    only the ranges' counts of a group meet, which are as many as there are tasks."""
    dealt = df.withColumn("__tie", F.rand(7)).repartitionByRange(*group, *order, "__tie").withColumn("__range", F.spark_partition_id())
    dealt = cut(dealt, "ranges")
    counts = dealt.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*group, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    nth = F.row_number().over(Window.partitionBy(*group, "__range").orderBy(*order, "__tie"))
    return dealt.withColumn(name, nth).join(first, [*group, "__range"]).withColumn(name, F.col(name) + F.col("__first")).drop("__range", "__first", "__tie")


def with_least(edges: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """edges (u, v) with m of least (u, m, n). The edges of hubs, which are HOT at
    most by their counts n, meet a broadcast; only the others are shuffled."""
    hubs = least.where(F.col("n") > max(64, ends // HOT)).select("u", F.col("m").alias("hub_m"))
    told = edges.join(F.broadcast(hubs), "u", "left")
    rest = told.where("hub_m is null").select("u", "v").join(least.select("u", "m"), "u")
    return told.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m")).unionByName(rest)


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: columns a, b (any comparable type). Returns (node, component) for every
    node of an edge, component being the smallest node reachable. Each round is a
    shuffle of at most the edge count; minima are pre-aggregated map-side, and a
    hub's edges stay where they are and meet its minimum by a broadcast of bounded
    size. Rounds end when no edge changes.
    """
    seen = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")]
    e = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    now = e.agg(*seen).first()
    for _ in range(max_rounds if now["n"] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # large star: neighbours above u move to the least neighbour of u
        big = with_least(both.where("v > u"), low, 2 * now["n"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        big = big.distinct()
        # small star: neighbours not above u, and u, move to the least of them
        low2 = big.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        moved = with_least(big, low2, now["n"])
        small = (
            moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low2.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        new = cut(small, "edges")
        before, now = now, new.agg(*seen).first()
        drop(e)
        e = new
        if now == before:
            break
    else:
        if now["n"]:
            raise RuntimeError("components did not settle")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
