"""Near duplicates: one-permutation hashing, banded buckets, star-shaped edges.

1. One pass turns every whole text into its shingle set's size and key and,
   by a one-permutation signature with optimal densification, band keys of 7
   bins; there are as many bands as the limit needs (24 for 85 %, 40 for 80 %).
2. Texts with equal sets form a class; only class representatives go on.
3. Buckets of equal band keys give a star each: the member whose buckets hold
   most others is the hub, every other member a spoke. So a bucket of n members
   gives n - 1 candidate edges. Links are joined to components.
4. In buckets that still hold several components, a member of each smaller one is
   compared with HUBS members of the largest.
5. What is left of such buckets is dealt into blocks, and block pairs are compared
   whole: a block pair returns a spanning forest of its links, never its pairs.
   So every two sets that share a bucket are in one component or were compared.

Every comparison is on full sets, grouped so that a hub's set is sent once to a block
of its spokes. A block is bounded by rows and by items, whatever the bucket's size.

A row whose text is null, empty or without words has n_shingles 0 and is linked
with nothing. Repeated rows are one class. A row with a null id links like any
other; it has a null component_id and a null kept. An empty table gives an empty
result. Further columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, drop, spread_join, table
from .shingles import band_keys, set_key, shingle_set, signature

#: Bins of a band, most bands of so many bins, and the greatest chance that a
#: pair at the limit shares no band.
ROWS, MOST_BANDS, MISS = 7, 128, 1e-4
#: Members of a bucket's largest component that stand for it in step 4.
HUBS = 4
#: Most members and items of a block, in the mean.
BLOCK, ITEMS = 512, 1 << 20


def banding(percent: int) -> tuple[int, int]:
    """(bands, bins of a band) for a limit of the similarity."""
    for rows in range(ROWS, 0, -1):
        same = (percent / 100) ** rows
        bands = math.ceil(math.log(MISS) / math.log1p(-same)) if same < 1 else 1
        if bands <= MOST_BANDS:
            break
    return bands, rows


def signatures(df: DataFrame, n: int, count: int, width: int) -> DataFrame:
    """(doc_id, h, n_shingles, set, bands) of every row (doc_id, h, text); set and
    bands are null if the text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, key, bands = [], [], []
            for x in b.column(2):
                s = shingle_set(x.as_py(), n)
                size.append(len(s))
                key.append(set_key(s) if len(s) else None)
                bands.append(band_keys(signature(s, count * width), count, width) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "h", "n_shingles", "set", "bands"])

    return df.mapInArrow(run, "doc_id long, h long, n_shingles long, set binary, bands array<long>")


def full_sets(df: DataFrame, n: int) -> DataFrame:
    """(set, items): the full shingle sets of the rows of df (text, set), where the
    text has that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(w.as_py(), shingle_set(x.as_py(), n)) for x, w in zip(b.column(0), b.column(1), strict=True)]
            got = [(w, s) for w, s in got if set_key(s) == w]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in got], pa.binary()), pa.array([s.view(np.int64) for _, s in got], pa.list_(pa.int64()))], names=["set", "items"])

    return df.select("text", "set").mapInArrow(run, "set binary, items array<long>")


def compared(percent: int):
    """The function that compares one group: rows of side 0 with those of side 1,
    or all rows with each other where side is 2. It returns a spanning forest of
    the links between rows of different components."""

    def compare(t: pa.Table) -> pa.Table:
        side, sets = t["side"].to_numpy(), t["set"].to_pylist()
        items = t["items"].combine_chunks()
        ends = items.offsets.to_numpy().astype(np.int64)
        start, size = ends[:-1] - ends[0], np.diff(ends)
        flat = items.values.to_numpy()[ends[0]: ends[-1]]
        root = t["component"].combine_chunks().dictionary_encode().indices.to_numpy().copy()
        band = t["band"].to_numpy()
        bands = np.stack([np.asarray(x, np.int64) for x in t["bands"].to_pylist()]) if len(band) and band.max() > 0 else None
        left = np.flatnonzero(side != 1)
        dense = len(left) > 3
        if dense:
            value, flat = np.unique(flat, return_inverse=True)
            mark = np.zeros(len(value), bool)
        a, b = [], []
        for i in left:
            ok = (root != root[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
            ok[: i + 1] &= side[: i + 1] != 2
            ok &= side != 0
            if bands is not None and ok.any():  # two sets are compared in their first common bucket
                some = np.flatnonzero(ok)
                ok[some] = ~(bands[some, : band[i]] == bands[i, : band[i]]).any(1)
            if not ok.any():
                continue
            own = flat[start[i]: start[i] + size[i]]
            if dense:
                mark[own] = True
                hit = mark[flat]
                mark[own] = False
            else:
                hit = np.isin(flat, own, assume_unique=False)
            same = np.add.reduceat(hit, start, dtype=np.int64)
            for j in np.flatnonzero(ok & (100 * same >= percent * (size + size[i] - same))):
                if root[i] != root[j]:
                    root[root == root[j]] = root[i]
                    a.append(sets[i])
                    b.append(sets[j])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return compare


def links_in(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within groups (g, i, j) of rows (side, set, component, band, bands)."""
    rows = groups.join(sets, "set")
    return rows.select("g", "i", "j", "side", "set", "component", "band", "bands", "items").groupBy("g", "i", "j").applyInArrow(compared(percent), "a binary, b binary")


def blocks(rows: Column, items: Column) -> Column:
    return F.ceil(F.greatest(rows / F.lit(BLOCK), items / F.lit(ITEMS))).cast("int")


def dealt(n: Column) -> Column:
    """The block of a set among n."""
    return F.pmod(F.xxhash64("set", F.lit("block")), n).cast("int")


def stars(pairs: DataFrame) -> DataFrame:
    """Groups of candidate pairs (hub, set, n): n blocks of a hub's spokes, each with
    the hub. A spoke's block follows from its row, so no hub is gathered."""
    none = [F.lit(0).alias("band"), F.array().cast("array<long>").alias("bands")]
    told = pairs.select("hub", "set", dealt(F.col("n")).alias("i")).distinct()
    spokes = told.select(F.col("hub").alias("g"), "i", F.lit(0).alias("j"), F.lit(1).alias("side"), "set", F.col("set").alias("component"), *none)
    hubs = told.select("hub", "i").distinct().select(F.col("hub").alias("g"), "i", F.lit(0).alias("j"), F.lit(0).alias("side"), F.col("hub").alias("set"), F.col("hub").alias("component"), *none)
    return spokes.unionByName(hubs).withColumn("g", F.hex("g"))


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components of found (node, component) after further links (a, b); only
    the labels that the links name go through the rounds again."""
    of = [found.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"]
    between = links.join(of[0], "a", "left").join(of[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    up = cut(components(between), "labels").select("node", F.col("component").alias("least"))
    old = found.join(up.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    new = up.join(found.select("node"), "node", "left_anti").select("node", F.col("least").alias("component"))
    return cut(old.unionByName(new), "components")


def mixed(member: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of member in buckets of several components, with their component."""
    where = member.join(found.select(F.col("node").alias("set"), "component"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    several = where.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("rows"), F.sum("size").alias("items")).where("lo <> hi")
    return cut(where.join(several.select("key", "rows", "items"), "key"), "mixed")


def classes(df: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, n_shingles, set) of every row, h a hash of the text, and
    (set, component) of every set that is linked with another."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    rows = cut(signatures(docs, words, *banding(percent)), "signatures")
    # one row stands for a class of equal sets
    reps = rows.where("set is not null").groupBy("set").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "h", "n_shingles", "bands")).alias("r"))
    reps = cut(reps.select("set", "r.*"), "reps")
    member = reps.select("set", F.col("n_shingles").alias("size"), F.posexplode("bands").alias("band", "key"))
    often = member.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = cut(member.join(often, "key"), "members")
    wanted = member.select("set").distinct().join(reps.select("set", "doc_id", "no_id", "h"), "set")
    texts = docs.withColumn("no_id", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    sets = cut(full_sets(texts.join(wanted, ["doc_id", "no_id", "h"]), words).dropDuplicates(["set"]), "sets")

    degree = member.groupBy("set").agg(F.sum("n").alias("degree"), F.max("n").alias("most"))
    ranked = member.select("key", "set", "size").join(degree, "set")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("degree", "set", "size", "most")).alias("hub")).select("key", F.col("hub.set").alias("hub"), F.col("hub.size").alias("hub_size"), blocks(F.col("hub.most"), F.col("hub.most") * F.col("hub.size")).alias("n"))
    alike = F.least("size", "hub_size") * 100 >= F.greatest("size", "hub_size") * percent
    pairs = cut(member.select("key", "set", "size").join(hubs, "key").where((F.col("hub") != F.col("set")) & alike).select("hub", "set", "n").distinct(), "pairs")
    found = cut(components(links_in(stars(pairs), sets, percent)), "components")
    drop(pairs)

    # some of the largest component of a bucket against one of each other
    where = mixed(member.drop("n"), found)
    few = [F.min(F.struct(F.xxhash64("set", F.lit(k)).alias("h"), "set", "size")).alias(f"m{k}") for k in range(HUBS)]
    parts = where.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), *few)
    main = parts.groupBy("key").agg(F.max(F.struct("n", "component", F.array(*(F.col(f"m{k}") for k in range(HUBS))).alias("hubs"))).alias("main"), F.count(F.lit(1)).alias("parts"))
    main = main.select("key", F.col("main.component").alias("main"), "main.hubs", "parts")
    tried = parts.select("key", "component", F.col("m0.set").alias("set"), F.col("m0.size").alias("size")).join(main, "key").where("component <> main")
    tried = tried.select("set", "size", "parts", F.explode("hubs").alias("hub")).select(F.col("hub.set").alias("hub"), F.col("hub.size").alias("hub_size"), "set", "size", "parts").where(alike)
    tried = cut(tried.select("hub", "set", blocks(F.col("parts"), F.col("parts") * F.col("hub_size")).alias("n")).distinct(), "pairs")
    found = merged(found, links_in(stars(tried), sets, percent))
    drop(tried)

    # all that is left, block by block
    last = mixed(where.drop("component", "rows", "items"), found)
    where = last.withColumn("n", blocks(F.col("rows"), F.col("items"))).withColumn("at", dealt(F.col("n")))
    where = where.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    side = F.when(F.col("at") == F.col("other"), 2).otherwise((F.col("at") > F.col("other")).cast("int"))
    where = where.join(reps.select("set", "bands"), "set")
    left = where.select(F.col("key").cast("string").alias("g"), F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), side.alias("side"), "set", "component", "band", "bands")
    found = merged(found, links_in(left, sets, percent))
    for used in (member, sets, last):
        drop(used)
    return rows, found.select(F.col("node").alias("set"), "component")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of df; texts are linked
    where 100 * intersection >= percent * union of their sets of word shingles."""
    rows, found = classes(df, id_col, text_col, words, percent)
    own = rows.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).join(found, "set", "left")
    own = cut(own.where("component is not null or n > 1").withColumn("component", F.coalesce("component", "set")), "own")
    ids = own.groupBy("component").agg(F.min("least").alias("component_id"))
    of = cut(spread_join(own, ids, ["component"]).select("set", "component_id"), "of")
    out = rows.select("doc_id", "n_shingles", "set").join(of, "set", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """df with one row of each component: that of the least id (null last) and text
    hash. Rows are told apart by id and text, so a row whose id repeats under another
    text stays; equal rows are one. Rows without words are in no component and all stay."""
    rows, found = classes(df, id_col, text_col, words, percent)
    first = rows.where("set is not null").groupBy("set").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("row"))
    first = first.join(found, "set", "left").groupBy(F.coalesce("component", "set").alias("component")).agg(F.min("row").alias("row"))
    key = lambda i, h: F.concat_ws("|", F.coalesce(i.cast("string"), F.lit("null")), h.cast("string"))
    left = cut(first.select(key(F.col("row.doc_id"), F.col("row.h")).alias("__row")), "left")
    has = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    named = df.where(has).withColumn("__row", key(F.col(id_col).cast("long"), F.xxhash64(text_col))).dropDuplicates(["__row"])
    return named.join(left, "__row", "left_semi").select(*(F.col(f"`{c}`") for c in df.columns)).unionByName(df.where(~has))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
