"""Near-duplicate vectors by a pivot-permutation index.

1. Rows with the same label and the same components form a class; only class
   representatives go on, with their counts.
2. Reference points (pivots) are a bounded sample of the vectors: 2 sqrt(n) of
   them, between 32 and MAX_PIVOTS, less those within the limit of another, so that
   a dense cluster has one and its members agree on it. A vector is described by its PREFIX nearest
   pivots in order; with more than FLAT pivots those are sought in the groups of
   the nearest heads.
3. Inverted lists are kept for pairs of pivots: a list holds the vectors of a label
   that have both in their prefix. So two vectors meet where they share at least two
   pivots, and lists stay short as pivots grow with the vectors. Lists of one
   vector go before any vector is sent.
4. A list is dealt into blocks of BLOCK rows in the mean, and pairs of blocks are
   verified by cosine in double precision, two vectors in the list of their least
   common pair only. A block pair returns counts of links by vector and a spanning
   forest of the links, not the pairs. No list is capped: more blocks hold more rows,
   and every verified link counts.

Vectors that are null, zero or hold null or non-finite components, and rows
with a null label, are linked with nothing. Repeated rows link with each other.
A null id is linked with nothing and has a null component_id and kept. Vectors of
unlike length have no cosine. An empty table gives an empty result. Further columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, cut, drop, spread_join, table

#: Most pivots of a length of vectors, and those up to which all are compared.
MAX_PIVOTS, FLAT, HEADS = 65_536, 4096, 12
PREFIX, BLOCK = 8, 1024
#: Range of the hashes that draw the sample.
SPACE = 1 << 40


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Pivots:
    """Reference points of one length; nearest ones are found by cosine."""

    def __init__(self, ref: np.ndarray, flat: int = FLAT):
        self.ref, self.members = ref, None
        if len(ref) > flat:
            self.heads = ref[: int(len(ref) ** 0.5)]
            owner = np.concatenate([(ref[k: k + 4096] @ self.heads.T).argmax(1) for k in range(0, len(ref), 4096)])
            order = np.argsort(owner, kind="stable")
            self.members = np.split(order, np.cumsum(np.bincount(owner, minlength=len(self.heads)))[:-1])

    def nearest(self, x: np.ndarray, m: int) -> np.ndarray:
        """The m nearest pivots of each row, nearest first, ties by number."""
        if self.members is None:
            return np.argsort(-(x @ self.ref.T), axis=1, kind="stable")[:, :m].astype(np.int32)
        near = np.argsort(-(x @ self.heads.T), axis=1, kind="stable")[:, :HEADS]
        out = np.empty((len(x), m), np.int32)
        for k, heads in enumerate(near):
            some = np.sort(np.concatenate([self.members[h] for h in heads]))
            if len(some) < m:
                some = np.arange(len(self.ref))
            out[k] = some[np.argsort(-(self.ref[some] @ x[k]), kind="stable")[:m]]
        return out


def separated(ref: np.ndarray, cosine: float) -> np.ndarray:
    """The rows that are within the limit of no row kept before them. A cluster keeps
    one pivot however many of its vectors were drawn, so its members agree on it."""
    kept = ref[:0]
    for at in range(0, len(ref), 256):
        some = ref[at: at + 256]
        some = some[(some @ kept.T).max(1, initial=-1) < cosine]
        near = some @ some.T >= cosine
        own: list[int] = []
        for k in range(len(some)):
            if not near[k, own].any():
                own.append(k)
        kept = np.concatenate([kept, some[own]])
    return kept


def forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row the least row that its links (a, b) reach, by label passing."""
    label = np.arange(len(ids))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def verify(x: np.ndarray, prefix: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, p: int, q: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with links, their counts of linked vectors, and the least row that each
    reaches: the links of block left with block right of the list of pivots p < q."""
    a, b = np.nonzero(x[left] @ x[right].T >= cosine)
    if same:
        a, b = a[a < b], b[a < b]
    a, b = left[a], right[b]
    keep = []
    for at in range(0, len(a), 1 << 16):
        u, v = prefix[a[at: at + (1 << 16)]], prefix[b[at: at + (1 << 16)]]
        common = (u[:, :, None] == v[:, None, :]).any(2)
        keep.append(~(common & (u < q) & (u != p)).any(1))
    if keep:
        keep = np.concatenate(keep)
        a, b = a[keep], b[keep]
    count = np.bincount(a, n[b], len(x)) + np.bincount(b, n[a], len(x))
    hit = np.flatnonzero(count)
    return hit, count[hit].astype(np.int64), forest(n, a, b)[hit]


def verified(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Links of block pairs; rows come sorted by (label, dim, p, q, i, j)."""
    rest: pa.Table | None = None

    def done(t: pa.Table) -> pa.RecordBatch:
        keys = [t[c].combine_chunks() for c in ("label", "dim", "p", "q", "i", "j")]
        codes = [(k.dictionary_encode().indices if pa.types.is_string(k.type) else k).to_numpy(zero_copy_only=False) for k in keys]
        cut_at = np.flatnonzero(np.any([np.diff(c) != 0 for c in codes], axis=0)) + 1
        ids, n, block = t["key"].to_pylist(), t["n"].to_numpy(), t["block"].to_numpy()
        raw, prefix = t["v"].to_pylist(), np.stack([np.asarray(x) for x in t["prefix"].to_pylist()])
        node, links, other = [], [], []
        for lo, hi in zip([0, *cut_at.tolist()], [*cut_at.tolist(), t.num_rows], strict=True):
            dim, p, q, i, j = (int(c[lo]) for c in codes[1:])
            own = block[lo:hi]
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            if not len(left) or not len(right) or hi - lo < 2:
                continue
            x = unit(np.frombuffer(b"".join(raw[lo:hi]), np.float64 if len(raw[lo]) == 8 * dim else np.float32).reshape(-1, dim).astype(np.float64))
            hit, count, low = verify(x, prefix[lo:hi], n[lo:hi], left, right, i == j, p, q, cosine)
            node += [ids[lo + k] for k in hit]
            links.append(count)
            other += [ids[lo + k] for k in low]
        return pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(np.concatenate(links) if links else [], pa.int64()), pa.array(other, pa.binary())], names=["node", "n_links", "other"])

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        # the last block pair may go on in the next batch
        last = [t[c][t.num_rows - 1].as_py() for c in ("label", "dim", "p", "q", "i", "j")]
        at = t.num_rows
        lo = 0
        while at > lo:  # rows are sorted: the first row of the last block pair
            mid = (at + lo) // 2
            if [t[c][mid].as_py() for c in ("label", "dim", "p", "q", "i", "j")] == last:
                at = mid
            else:
                lo = mid + 1
        rest = t.slice(lo)
        if lo:
            yield done(t.slice(0, lo))
    if rest is not None:
        yield done(rest)


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.93) -> DataFrame:
    """(id, n_links, component_id, kept) of every row of df."""
    spark = df.sparkSession
    single = df.schema[vec_col].dataType.simpleString() == "array<float>"
    raw = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    bad = "exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) or not exists(v, x -> x <> 0) or size(v) = 0"
    rows = raw.withColumn("v", F.expr(f"case when v is null or label is null or id is null or {bad} then null else transform(v, x -> x + 0.0D) end"))
    rows = rows.withColumn("key", F.expr("case when v is not null then unhex(md5(concat_ws(',', label, transform(v, x -> cast(x as string))))) end"))
    reps = rows.where("v is not null").groupBy("key").agg(F.min("id").alias("node"), F.count(F.lit(1)).cast("long").alias("n"), F.first("v").alias("v"), F.first("label").alias("label"))
    reps = cut(reps.withColumn("dim", F.size("v")).withColumn("place", F.pmod(F.xxhash64("key"), F.lit(SPACE))), "vectors")
    sizes = {r["dim"]: r["n"] for r in reps.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {d: int(min(MAX_PIVOTS, max(32, 2 * n**0.5))) for d, n in sizes.items()}
    if sizes:
        # the vectors of least hash of each length: of those under a bound that about twice as many are under
        of = spark.createDataFrame([(d, want[d], int(min(1.0, (2 * want[d] + 64) / sizes[d]) * SPACE)) for d in sizes], "dim int, want int, bound long")
        nth = F.row_number().over(Window.partitionBy("dim").orderBy("place", "key"))
        sample = reps.join(F.broadcast(of), "dim").where("place < bound").withColumn("nth", nth).where("nth <= want").select("dim", "nth", "v").collect()
    else:
        sample = []
    chosen: dict[int, list] = {d: [] for d in sizes}
    for r in sorted(sample, key=lambda r: (r["dim"], r["nth"])):
        chosen[r["dim"]].append(r["v"])
    shared = spark.sparkContext.broadcast({d: Pivots(separated(unit(np.array(v, np.float64)), cosine)) for d, v in chosen.items()})

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, vecs = b.column(3).to_numpy(), b.column(4).to_pylist()
            prefix, data = [None] * len(vecs), [None] * len(vecs)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = np.array([vecs[k] for k in at], np.float64)
                ref = shared.value[d]
                near = ref.nearest(unit(x), min(PREFIX, len(ref.ref)))
                for k, i in enumerate(at.tolist()):
                    prefix[i], data[i] = near[k], x[k].astype(np.float32 if single else np.float64).tobytes()
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(prefix, pa.list_(pa.int32())), pa.array(data, pa.binary())], names=["key", "n", "label", "dim", "prefix", "v"])

    told = cut(reps.select("key", "n", "label", "dim", "v").mapInArrow(describe, "key binary, n long, label string, dim int, prefix array<int>, v binary"), "prefixes")
    # a vector with one pivot to choose from is in that pivot's list
    order = F.array_sort("prefix")
    pairs = F.when(F.size(order) == 1, F.array(F.struct(order[0].alias("p"), order[0].alias("q")))).otherwise(F.flatten(F.transform(order, lambda p, i: F.transform(F.slice(order, i + 2, F.size(order)), lambda q: F.struct(p.alias("p"), q.alias("q"))))))
    listed = told.select("key", "label", "dim", F.explode(pairs).alias("pq")).select("key", "label", "dim", "pq.p", "pq.q")
    long = listed.groupBy("label", "dim", "p", "q").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    long = long.withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
    dealt = listed.join(long.drop("rows"), ["label", "dim", "p", "q"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    sent = dealt.join(told.select("key", "n", "prefix", "v"), "key").repartition("label", "dim", "p", "q", "i", "j").sortWithinPartitions("label", "dim", "p", "q", "i", "j")
    sent = sent.select("label", "dim", "p", "q", "i", "j", "block", "key", "n", "prefix", "v")
    links = cut(sent.mapInArrow(lambda batches: verified(batches, cosine), "node binary, n_links long, other binary"), "links")
    degree = links.groupBy("node").agg(F.sum("n_links").alias("linked"))
    found = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = reps.select("key", "node", "n").join(found.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = cut(named, "named")
    least = named.groupBy("component").agg(F.min("node").alias("component_id"))
    of = spread_join(named, least, ["component"]).join(degree.select(F.col("node").alias("key"), "linked"), "key", "left")
    of = cut(of.select("key", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links")).where("n_links > 0"), "of")
    drop(links)
    out = rows.select("id", "key").join(of, "key", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
