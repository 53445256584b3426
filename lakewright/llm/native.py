"""Column expressions that the native operators share; JVM functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches that one step of a running sum covers; two levels keep it linear in practice.
BLOCK = 256
SPANS = "array<struct<s:int,e:int,m:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def find_all(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<s, e, m>>, in code
    points, end exclusive. What split() leaves between the matches gives their
    places."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))
    none = F.array().cast(SPANS)

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["g"]
        end = at + F.coalesce(F.length(x["m"]), F.lit(0))
        row = F.struct(at.alias("s"), end.alias("e"), x["m"].alias("m"))
        return F.struct(end.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(row))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    blocks = let(zipped, lambda z: F.transform(F.sequence(F.lit(0), ((F.size(z) - 1) / BLOCK).cast("int")), lambda b: F.slice(z, b * BLOCK + 1, F.lit(BLOCK))))
    summed = F.transform(blocks, lambda blk: F.aggregate(blk, start, step))

    def carry(acc: Column, x: Column) -> Column:
        moved = F.transform(x["out"], lambda r: F.struct((r["s"] + acc["at"]).alias("s"), (r["e"] + acc["at"]).alias("e"), r["m"].alias("m")))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    nested = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out"))
    return F.aggregate(summed, nested, carry, lambda acc: F.flatten(acc["out"]))


def swept(rows: Column, kind: str, joins: Callable[[Column, Column], Column], merge: Callable[[Column, Column], Column]) -> Column:
    """Sorted rows (array of type kind) folded along: while the next row joins the
    current one they merge into one, else the current one is put out. Rows are put
    out in blocks, so that very many of them take linear time in practice."""
    none, empty = F.lit(None).cast(kind), F.array().cast(f"array<{kind}>")

    def step(acc: Column, r: Column) -> Column:
        cur, first = acc["cur"], acc["cur"].isNull()
        joined = F.coalesce(joins(cur, r), F.lit(False))
        return F.struct(F.when(first | ~joined, r).otherwise(merge(cur, r)).cast(kind).alias("cur"), F.when(first | joined, acc["out"]).otherwise(F.concat(acc["out"], F.array(cur))).alias("out"))

    def block(acc: Column, rs: Column) -> Column:
        got = F.aggregate(rs, F.struct(acc["cur"].alias("cur"), empty.alias("out")), step)
        return let(got, lambda g: F.struct(g["cur"].alias("cur"), F.concat(acc["out"], F.array(g["out"])).alias("out")))

    blocks = let(rows, lambda z: F.transform(F.sequence(F.lit(0), ((F.size(z) - 1) / BLOCK).cast("int")), lambda b: F.slice(z, b * BLOCK + 1, F.lit(BLOCK))))
    start = F.struct(none.alias("cur"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.aggregate(blocks, start, block, lambda acc: F.when(acc["cur"].isNull(), F.flatten(acc["out"])).otherwise(F.concat(F.flatten(acc["out"]), F.array(acc["cur"]))))
