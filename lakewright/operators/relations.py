"""Operators that a query language over trees needs and Spark lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, start, text): lines with their first byte's offset, from 0.
    Computed row by row: the offsets are a running sum inside one text."""
    parts = F.split(F.col(text_col), "\n", -1)
    sizes = F.transform(parts, lambda p: F.octet_length(p) + 1)
    # running sum in blocks, so that a text of very many lines stays cheap
    block = 512

    def scan(xs: Column) -> Column:
        return F.aggregate(xs, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def blocks(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), ((F.size(xs) - 1) / block).cast("int")), lambda b: scan(F.slice(xs, b * block + 1, F.lit(block))))

    scanned = F.transform(F.array(sizes), blocks)[0]
    moved = F.aggregate(scanned, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<bigint>>").alias("out")), lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["out"], F.array(F.transform(x["out"], lambda v: v + a["at"]))).alias("out")), lambda a: F.flatten(a["out"]))
    rows = df.select(F.col(id_col), F.posexplode(F.arrays_zip(moved.alias("start"), parts.alias("text"))).alias("line", "row"))
    return rows.select(id_col, (F.col("line") + 1).alias("line"), F.col("row")["start"].alias("start"), F.col("row")["text"].alias("text"))


def line_col(points: DataFrame, lines: DataFrame, id_col: str, offset_col: str = "offset") -> DataFrame:
    """points with 1-based line and col (in bytes) of their byte offsets. Points and
    starts of lines are sorted together, so that nothing is broadcast, whatever size the
    planner takes generated rows for, and a text of many lines and points stays linear."""
    line = F.struct("line", "start", (F.col("start") + F.octet_length("text") + 1).alias("end"))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in points.schema]
    starts = lines.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col("start").cast("long").alias("__at"), F.lit(0).alias("__point"), line.alias("__line"), *none)
    asked = points.select(F.col(id_col).alias("__id"), F.col(offset_col).cast("long").alias("__at"), F.lit(1).alias("__point"), F.lit(None).cast(starts.schema["__line"].dataType).alias("__line"), *points.columns)
    w = Window.partitionBy("__id").orderBy("__at", "__point").rowsBetween(Window.unboundedPreceding, 0)
    on = starts.unionByName(asked).withColumn("__line", F.last("__line", ignorenulls=True).over(w)).where("__point = 1")
    inside = F.col("__at") < F.col("__line.end")
    return on.select(*points.columns, F.when(inside, F.col("__line.line")).alias("line"), F.when(inside, F.col(offset_col) - F.col("__line.start") + 1).alias("col"))


#: Rows of a lookup table that may be broadcast, and rows of one key from which on its
#: entries are.
FEW, HOT = 50_000, 20_000


def lookup(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left joined with the few rows that right has for each key. The entries of keys that
    very many rows share are broadcast, so that no such key meets in one task; the same
    holds for all entries that left uses, if they are few. left is read several times."""
    from ..storage import cut

    used = left.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    need = cut(right.join(used, on), "lookup")
    plain = [c for c in need.columns if c != "__n"]
    if need.count() <= FEW:
        return left.join(F.broadcast(need.select(*plain)), on, how)
    hot = need.where(F.col("__n") > HOT)
    keys = F.broadcast(hot.select(*on).distinct())
    cool = left.join(keys, on, "left_anti").join(need.where(F.col("__n") <= HOT).select(*plain), on, how)
    return left.join(F.broadcast(hot.select(*plain)), on).unionByName(cool)


def closure(edges: DataFrame, source: str, target: str, max_rounds: int = 64) -> DataFrame:
    """Transitive closure (source, target, depth) with least depths, cycle-safe,
    without self pairs. Each round joins only the pairs that the last one found."""
    from ..storage import cut, drop

    base = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    base = cut(base, "edges")
    known = base.withColumn("depth", F.lit(1))
    fresh = known
    for depth in range(2, max_rounds + 2):
        step = fresh.select("a", F.col("b").alias("m")).join(base.select(F.col("a").alias("m"), "b"), "m").select("a", "b").where("a <> b").distinct()
        fresh = cut(step.join(known.select("a", "b"), ["a", "b"], "left_anti").withColumn("depth", F.lit(depth)), "fresh")
        if not fresh.take(1):
            drop(fresh)
            return known.select(F.col("a").alias(source), F.col("b").alias(target), "depth")
        known = known.unionByName(fresh)
    raise RuntimeError("closure did not settle")


def innermost(points: DataFrame, intervals: DataFrame, group: list[str], at: str, lo: str, hi: str, id_col: str, grain: int) -> DataFrame:
    """points with the id of the shortest interval lo <= at < hi of their group,
    null if there is none. Intervals are dealt to cells of `grain`, so that the
    range join is an equi-join on (group, cell) with a residual."""
    cell = F.floor(F.col(at) / grain)
    left = points.withColumn("__row", F.monotonically_increasing_id()).withColumn("__cell", cell)
    cells = F.explode(F.sequence(F.floor(F.col(lo) / grain), F.floor((F.col(hi) - 1) / grain)))
    right = intervals.where(F.col(hi) > F.col(lo)).select(*(F.col(g).alias(f"__{g}") for g in group), F.col(lo).alias("__lo"), F.col(hi).alias("__hi"), F.col(id_col).alias("__id"), cells.alias("__c"))
    on = [F.col(g) == F.col(f"__{g}") for g in group] + [F.col("__cell") == F.col("__c"), F.col(at) >= F.col("__lo"), F.col(at) < F.col("__hi")]
    both = left.join(right, on, "left")
    best = both.groupBy("__row", *points.columns).agg(F.min(F.struct((F.col("__hi") - F.col("__lo")).alias("n"), F.col("__lo").alias("lo"), F.col("__id").alias("id"))).alias("m"))
    return best.select(*points.columns, F.col("m.id").alias(id_col))


def overlap_status(edits: DataFrame, group: str, start: str, end: str, id_col: str) -> DataFrame:
    """edits with status: subsumed (strictly inside another of the group, or equal
    to one with a lesser id), crossing (overlaps another without nesting), else
    ok. Touching intervals do not overlap."""
    o = edits.select(F.col(group).alias("__g"), F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(id_col).alias("__i"))
    meets = (F.col(group) == F.col("__g")) & (F.col(id_col) != F.col("__i")) & (F.col(start) < F.col("__e")) & (F.col("__s") < F.col(end))
    inside = (F.col("__s") <= F.col(start)) & (F.col(end) <= F.col("__e")) & ((F.col("__e") - F.col("__s") > F.col(end) - F.col(start)) | (F.col("__i") < F.col(id_col)))
    nests = ((F.col(start) <= F.col("__s")) & (F.col("__e") <= F.col(end))) | ((F.col("__s") <= F.col(start)) & (F.col(end) <= F.col("__e")))
    both = edits.join(o, meets, "left")
    got = both.groupBy(*edits.columns).agg(F.max(F.coalesce(inside, F.lit(False))).alias("sub"), F.max(F.coalesce(~nests, F.lit(False))).alias("cross"))
    return got.select(*edits.columns, F.when(F.col("sub"), "subsumed").when(F.col("cross"), "crossing").otherwise("ok").alias("status"))


def outermost(rows: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Rows whose interval lies strictly in no other of their group: a running
    maximum of ends over distinct intervals sorted by start, longest first."""
    w = Window.partitionBy(group).orderBy(F.col(start), F.col(end).desc()).rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.select(group, start, end).distinct()
    kept = spans.withColumn("__m", F.max(end).over(w)).where(F.col("__m").isNull() | (F.col("__m") < F.col(end))).drop("__m")
    return rows.join(kept, [group, start, end], "left_semi").select(*rows.columns)


def prioritised(left: DataFrame, right: DataFrame, on: list[str], priority: str) -> DataFrame:
    """Left join that keeps the match of least priority for each key."""
    best = right.groupBy(*on).agg(F.min(F.struct(F.col(priority), *(F.col(c) for c in right.columns if c not in (*on, priority)))).alias("__m"))
    return left.join(best, on, "left").select(*left.columns, *(F.col(f"__m.{c}").alias(c) for c in right.columns if c not in on))
