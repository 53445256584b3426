"""Packing: shortest-pack-first over the length histogram.

1. Every document is encoded once, closed with id 0 and cut into pieces of 1024
   ids and a remainder. A piece carries its length, checksum and rank among the
   pieces of its length in its task.
2. Piece counts by length (1024 rows at most) go to the driver, where lengths
   are placed longest first into the pack with the most room that still fits
   them; what is kept is not packs but patterns with counts.
3. Patterns come back as ranges of ranks: the pieces of one length with ranks
   lo..hi sit at one offset of consecutive sequences. Ranks over all tasks are
   task offsets plus ranks in the task, so no length is gathered in one task.

A null or empty text has the closing id alone. Repeated rows are packed each.
An empty table gives an empty result. A sequence is padded to 1024, except
where its length is a power of two. Further columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table
from .tokens import codec, default_path

SIZE = 1024
#: Rank ranges that may be broadcast; more are joined by a shuffle.
BROADCAST_SLOTS = 50_000
#: Ranks of a length that are joined together.
BUCKET = 4096


def shortest_pack_first(hist: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) with counts that use up the histogram."""
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for length in sorted(hist, reverse=True):
        left = hist[length]
        while left:
            free = max((r for r, packs in room.items() if packs and r >= length), default=0)
            if not free:
                room[size - length][(length,)] += left
                break
            # as many of these as each shortest pack can take at once
            pattern, n = next(iter(room[free].items()))
            used = min(n, left)
            if used == n:
                del room[free][pattern]
            else:
                room[free][pattern] = n - used
            room[free - length][(*pattern, length)] += used
            left -= used
    return [(p, n) for packs in room.values() for p, n in packs.items() if n]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, lo, hi, first sequence, offset): ranks lo <= r < hi of a length
    go to sequence first + r - lo at that offset."""
    seen: dict[int, int] = defaultdict(int)
    out, base = [], 0
    for lengths, n in patterns:
        at = 0
        for x in lengths:
            out.append((x, seen[x], seen[x] + n, base, at))
            seen[x] += n
            at += x
        base += n
    return out


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, size: int = SIZE) -> DataFrame:
    """One row per piece, with the task and the rank in the task by length."""
    path = path or default_path()
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "part", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, part = codec(path), TaskContext.get().partitionId()
        seen = [0] * (size + 1)
        for b in batches:
            of, rows = [], []
            for i, x in enumerate(b.column(1)):
                ids = np.append(c.encode(x.as_py()), np.uint32(0)).astype("<u4", copy=False)
                data, n = memoryview(ids.tobytes()), len(ids)
                for at in range(0, n, size):
                    k = min(size, n - at)
                    of.append(i)
                    rows.append((at, k, zlib.crc32(data[4 * at: 4 * (at + k)]), n, part, seen[k]))
                    seen[k] += 1
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), *(pa.array(x, pa.int64()) for x in cols)], names=names)

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, size: int = SIZE) -> DataFrame:
    """Pieces of every row of df with their sequence_id and offset."""
    spark = df.sparkSession
    cutted = cut(pieces(df, id_col, text_col, path, size), "pieces")
    by_task = cut(cutted.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    hist = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = slots(shortest_pack_first(hist, size))
    slot = spark.createDataFrame(rows, "length long, lo long, hi long, base long, offset long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    small = len(rows) <= BROADCAST_SLOTS
    # a piece has its rank in its length; ranges are dealt into buckets of ranks, so a
    # piece meets the ranges of its own bucket only, and no length is in one task
    ranked = cutted.join(first, ["part", "length"]).withColumn("rank", F.col("first") + F.col("nth")).withColumn("bucket", F.floor(F.col("rank") / BUCKET))
    dealt = slot.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / BUCKET), F.floor((F.col("hi") - 1) / BUCKET))))
    out = ranked.join(F.broadcast(dealt) if small else dealt, ["length", "bucket"]).where("rank >= lo and rank < hi")
    return out.select(id_col, "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
