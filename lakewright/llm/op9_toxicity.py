"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are the words of a whole text. The examples are a bounded sample of distinct
labelled texts; every term of every example is in the index, and document
frequencies come from all documents. The examples' vectors form an inverted index
in blocks of BLOCK examples: a term keeps its greatest weight in each block, so a
query's upper bound for a block is a sum of products, and only blocks that can reach
the K-th best cosine are scored. Terms of very many examples would be in every block;
they are rows of a matrix instead, and their exact sums are part of the bound. The
result equals a full scan.

The K neighbours vote by distance against a prior. A neighbour's vote is what the
shared terms that depend on the label add to the cosine, each times its dependence,
plus a high power of the cosine itself, by which a near copy of an
example decides alone. A term's dependence is the lower confidence bound of its
log odds ratio in the examples. A logistic fit on examples that were left out of
index and dependences, weighted to the true shares of the labels, turns votes into
scores. A text without a known term has the prior's score.

Null and empty texts have no terms. Rows of one id, or of one text, with unlike
labels count as toxic; labels of null ids or texts do not count. Ties between
neighbours go by the hash of the example's text. With no labelled row every score
is 0. Repeated rows repeat; an empty table gives an empty result. Further columns
are carried under names that clash with none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop, table
from .op4_language import fit_scale

#: Most examples of a label: it bounds the index and what the driver holds.
PER_LABEL = 1500
BLOCK, K = 64, 40
#: Share of the examples above which a term is a row of a matrix, and the texts
#: that meet the matrix together.
OFTEN, TOGETHER = 0.06, 64
#: Standard errors below the log odds ratio at which a term's dependence is read,
#: weight of the prior in votes, and the power by which near copies decide alone.
SURE, PRIOR_WEIGHT, COPY = 2.0, 0.02, 16
_WORD = re.compile(r"\w+")


def terms(text: str | None) -> Counter:
    """Counts of a whole text's words."""
    return Counter(_WORD.findall(text.lower())) if text else Counter()


def dependence(pos: np.ndarray, neg: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Lower confidence bound of the size of terms' log odds ratios; 0 if unsure."""
    odds = np.log((pos + 0.5) / (n1 + 1)) - np.log((neg + 0.5) / (n0 + 1))
    return np.maximum(0.0, np.abs(odds) - SURE * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5)))


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The numbers of all ranges start..stop, one after another."""
    n = stop - start
    return np.repeat(stop - np.cumsum(n), n) + np.arange(n.sum())


class Index:
    """Block-max inverted index of examples; vectors have length one. Entry k is a
    term's part of a block: block[k], greatest weight top[k], and postings
    first[k]..first[k + 1]; a term's entries are entry[t]..entry[t + 1]."""

    def __init__(self, vocab: list[str], idf: np.ndarray, docs: list[tuple[np.ndarray, np.ndarray]], labels: list[int], ids: list[int], keys: list[int]):
        """docs: the numbers of each example's terms, and their counts."""
        flat = np.empty((sum(len(t) for t, _ in docs), 2), np.int32)
        at = 0
        for t, n in docs:
            by = np.argsort(t)
            flat[at: at + len(t), 0], flat[at: at + len(t), 1] = t[by], n[by]
            at += len(t)
        self.__setstate__({"vocab": "\n".join(vocab), "idf": np.asarray(idf, np.float64), "sizes": np.array([len(t) for t, _ in docs], np.int64), "flat": flat, "labels": np.array(labels, np.int8), "ids": np.array(ids, np.int64), "keys": np.array(keys, np.int64), "prior": 0.0, "scale": (1.0, 0.0)})

    def __getstate__(self) -> dict:
        """What the index is made of; it is sent so, and built where it is used first."""
        return self.source | {"prior": self.prior, "scale": self.scale}

    def __setstate__(self, state: dict) -> None:
        self.source, self.prior, self.scale, self.idf = state, state["prior"], state["scale"], state["idf"]
        self.n = len(state["sizes"])

    def __getattr__(self, name: str):
        if name.startswith("_") or "source" not in self.__dict__ or "depend" in self.__dict__:
            raise AttributeError(name)
        self.build()
        return getattr(self, name)

    def build(self) -> None:
        state = self.source
        vocab = state["vocab"].split("\n") if len(state["idf"]) else []
        self.term = {t: i for i, t in enumerate(vocab)}
        size, labels, ids, keys = (np.asarray(state[k]) for k in ("sizes", "labels", "ids", "keys"))
        self.blocks = -(-self.n // BLOCK)
        e = np.repeat(np.arange(self.n, dtype=np.int32), size)
        t = state["flat"][:, 0]
        w = (1 + np.log(state["flat"][:, 1])) * self.idf[t]
        w /= np.sqrt(np.bincount(e, w * w, self.n))[e]
        # examples with alike strongest terms share blocks
        strongest = np.full(self.n, -1)
        by = np.lexsort((w, e))
        last = np.flatnonzero(np.diff(e[by], append=-1))
        strongest[e[by[last]]] = t[by[last]]
        self.order = np.lexsort((keys, strongest, labels))
        del by, last
        self.labels, self.ids = labels[self.order].astype(np.float64), ids[self.order]
        self.tie = np.argsort(np.argsort(keys[self.order]))
        place = np.empty(self.n, np.int32)
        place[self.order] = np.arange(self.n)
        e = place[e]
        self.pos = np.bincount(t, self.labels[e], len(vocab))
        self.neg = np.bincount(t, 1 - self.labels[e], len(vocab))
        # terms of very many examples are rows of a matrix, all others are postings
        often = np.flatnonzero(self.pos + self.neg > max(8.0, self.n * OFTEN))
        self.row = np.full(len(vocab), -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.n))
        many = self.row[t] >= 0
        self.dense[self.row[t[many]], e[many]] = w[many]
        t, e, w = t[~many], e[~many], w[~many]
        by = np.lexsort((e, t))
        self.doc, self.weight = e[by], w[by]
        part = t[by].astype(np.int64) * self.blocks + self.doc // BLOCK
        del t, e, w, by
        new = np.flatnonzero(np.diff(part, prepend=-1))
        self.first = np.append(new, len(part)).astype(np.int32)
        self.block = (part[new] % max(self.blocks, 1)).astype(np.int32)
        self.top = np.maximum.reduceat(self.weight, new) if len(new) else np.empty(0)
        self.entry = np.searchsorted(part[new] // max(self.blocks, 1), np.arange(len(vocab) + 1))
        self.marked = (self.labels.sum(), self.n - self.labels.sum())
        self.depend = dependence(self.pos, self.neg, *self.marked)

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        get = self.term.get
        t = np.fromiter((get(x, -1) for x in counts), np.int64, len(counts))
        n = np.fromiter(counts.values(), np.float64, len(counts))
        known = np.flatnonzero(t >= 0)
        if not len(known):
            return np.empty(0, np.int64), np.empty(0)
        known = known[np.argsort(t[known])]
        t = t[known]
        w = (1 + np.log(n[known])) * self.idf[t]
        return t, w / np.sqrt(w @ w)

    def example(self, e: int) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of an example."""
        end = np.cumsum(self.source["sizes"])[self.order[e]]
        own = self.source["flat"][end - self.source["sizes"][self.order[e]]: end]
        t = own[:, 0].astype(np.int64)
        w = (1 + np.log(own[:, 1])) * self.idf[t]
        return t, w / np.sqrt(w @ w) if len(t) else w

    def frequent(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the matrix's terms add to the cosines of queries with all examples."""
        rows = np.zeros((len(queries), len(self.dense)))
        for k, (t, w) in enumerate(queries):
            r = self.row[t]
            rows[k, r[r >= 0]] = w[r >= 0]
        return rows @ self.dense

    def nearest(self, t: np.ndarray, w: np.ndarray, depend: np.ndarray, base: np.ndarray | None = None, skip: int = -1, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best positive cosines, their examples (ties by text hash), and what
        the terms that depend on the label add to each, times their dependence. base:
        what frequent() gives. A block's bound is its best base plus the greatest
        weights of the postings' terms."""
        if not len(t):
            return np.empty(0), np.empty(0, np.int64), np.empty(0)
        cos = (self.frequent([(t, w)])[0] if base is None else base).copy()
        few = self.row[t] < 0
        rare, rare_w, rare_d = t[few], w[few], depend[few]
        lo, hi = self.entry[rare], self.entry[rare + 1]
        ent = _ranges(lo, hi)
        of = np.repeat(np.arange(len(rare)), hi - lo)
        best_base = np.maximum.reduceat(cos, np.arange(0, self.n, BLOCK))
        bound = best_base + np.bincount(self.block[ent], rare_w[of] * self.top[ent], self.blocks)
        # k examples have at least this cosine, so no block below it matters
        least = np.partition(cos, self.n - k)[self.n - k] if self.n >= k and skip < 0 else 0.0
        some = (bound > 0) & (bound >= least - 1e-12)
        extra = np.zeros(self.n)
        if len(ent):
            if not some.all():
                use = some[self.block[ent]]
                ent, of = ent[use], of[use]
            a, b = self.first[ent], self.first[ent + 1]
            p, which = _ranges(a, b), np.repeat(of, b - a)
            add, doc = rare_w[which] * self.weight[p], self.doc[p]
            cos += np.bincount(doc, add, self.n)
            sure = np.flatnonzero(rare_d[which])
            if len(sure):
                extra = np.bincount(doc[sure], add[sure] * rare_d[which[sure]], self.n)
        if not some.all():
            cos[~np.repeat(some, BLOCK)[: self.n]] = 0
        if skip >= 0:
            cos[skip] = 0
        hit = np.flatnonzero(cos > 1e-12)
        if len(hit) > 4 * k:
            hit = hit[cos[hit] >= np.partition(cos[hit], len(hit) - k)[len(hit) - k] - 1e-9]
        value = np.round(cos[hit], 12)
        best = hit[np.lexsort((self.tie[hit], -value))[:k]]
        also = np.flatnonzero(~few & (depend > 0))
        more = (w[also] * depend[also]) @ self.dense[self.row[t[also]]][:, best] if len(also) else 0.0
        return np.round(cos[best], 12), best, extra[best] + more

    def votes(self, near: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
        """Log odds of the votes and the prior."""
        cos, best, extra = near
        v = extra + cos**COPY
        p = (v @ self.labels[best] + PRIOR_WEIGHT * self.prior) / (v.sum() + PRIOR_WEIGHT)
        p = min(max(float(p), 1e-4), 1 - 1e-4)
        return float(np.log(p / (1 - p)))

    def left_out(self, e: int) -> float:
        """The votes on example e as if it were not in the index."""
        t, w = self.example(e)
        y = self.labels[e]
        depend = dependence(self.pos[t] - y, self.neg[t] - (1 - y), self.marked[0] - y, self.marked[1] - (1 - y))
        return self.votes(self.nearest(t, w, depend, skip=e))

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[int]]]:
        """The score of each text, and the ids of its neighbours, nearest first."""
        vecs = [self.vector(terms(t)) for t in texts]
        a, b = self.scale
        out = []
        for (t, w), base in zip(vecs, self.frequent(vecs), strict=True):
            near = self.nearest(t, w, self.depend[t], base)
            out.append((float(1 / (1 + np.exp(-(a * self.votes(near) + b)))), self.ids[near[1]].tolist()))
        return out


def examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[list[tuple[int, int, int, np.ndarray, np.ndarray]], list[str], dict[int, int]]:
    """(text hash, label, least id, numbers of terms, counts) of PER_LABEL distinct
    labelled texts of each label at most, those of least hash; the terms; and how many
    texts each label has."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    own = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"))
    texts = cut(own.join(marked, "id").groupBy("h").agg(F.max("y").alias("y"), F.min("id").alias("id")), "marked")
    counts = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = {r["h"]: (r["y"], r["id"]) for y in sorted(counts) for r in texts.where(F.col("y") == y).orderBy(F.xxhash64("h"), "h").limit(PER_LABEL).collect()}
    drop(texts)
    if not drawn:
        return [], [], counts
    # at most 2 * PER_LABEL hashes: a bounded broadcast
    chosen = docs.sparkSession.createDataFrame([(h,) for h in sorted(drawn)], "h long")
    pick = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("text").alias("text"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [terms(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(g) for g in got], pa.list_(pa.string())), pa.array([list(g.values()) for g in got], pa.list_(pa.int32()))], names=["h", "t", "n"])

    number: dict[str, int] = {}  # the driver holds each string once
    out = []
    for r in pick.select("h", "text").mapInArrow(tally, "h long, t array<string>, n array<int>").toLocalIterator():
        out.append((r["h"], *drawn[r["h"]], np.array([number.setdefault(t, len(number)) for t in r["t"]], np.int32), np.array(r["n"], np.int32)))
    # terms are numbered by their order, whatever order the rows came in
    vocab = sorted(number)
    place = np.empty(len(vocab), np.int32)
    place[[number[t] for t in vocab]] = np.arange(len(vocab))
    return sorted(((h, y, i, place[t], n) for h, y, i, t, n in out), key=lambda x: x[0]), vocab, counts


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Index | None:
    """The calibrated index of labelled rows of docs; docs give document frequencies."""
    rows, vocab, counts = examples(docs, labels, id_col, text_col, label_col)
    if not rows:
        return None
    n, df = document_frequencies(docs.select(F.col(text_col).alias("text")), vocab)
    index = Index(vocab, np.log((1 + n) / (1 + df)) + 1, [r[3:] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[0] for r in rows])
    del rows, vocab, df
    total = sum(counts.values())
    index.prior = counts.get(1, 0) / total
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for b in batches:
            es = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([int(ix.labels[e]) for e in es], pa.int32()), pa.array([ix.left_out(e) for e in es], pa.float64())], names=["e", "y", "margin"])

    got = sorted(docs.sparkSession.range(0, index.n, 1, 16).withColumnRenamed("id", "e").mapInArrow(left_out, "e long, y int, margin double").collect())
    shared.destroy()
    y, margin = np.array([r["y"] for r in got]), np.array([r["margin"] for r in got])
    # each label's examples stand for all texts of that label
    share = np.where(y == 1, index.prior / max(y.mean(), 1e-9), (1 - index.prior) / max(1 - y.mean(), 1e-9))
    index.scale = fit_scale(margin, np.where(y == 1, 1.0, -1.0), share)
    return index


def document_frequencies(docs: DataFrame, vocab: list[str]) -> tuple[int, np.ndarray]:
    """Rows of docs, and for each term of the vocabulary those that hold it."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocab)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = shared.value, 0
        df = np.zeros(len(at), np.int64)
        for b in batches:
            n += b.num_rows
            for x in b.column(0):
                t = x.as_py()
                if t:
                    df[[at[w] for w in set(_WORD.findall(t.lower())) if w in at]] += 1
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *hit.tolist()], pa.int64()), pa.array([n, *df[hit].tolist()], pa.int64())], names=["term", "n"])

    out, n = np.zeros(len(vocab)), 0
    for r in docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        if r["term"] < 0:
            n = r["n"]
        else:
            out[r["term"]] = r["n"]
    return n, out


def score(df: DataFrame, index: Index | None, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None, keep_text: bool = False) -> DataFrame:
    """(id, kept columns, score, evidence) of every row of df, and its text as
    __text if keep_text; evidence holds the ids of the neighbours, nearest first."""
    own = df.select(F.col(id_col), F.col(text_col).alias("__text"), *(keep or []))
    rest = [f for f in own.schema.fields if keep_text or f.name != "__text"]
    schema = T.StructType([*rest, T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.LongType()))])
    shared = df.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for b in batches:
            got = []
            for at in range(0, b.num_rows, TOGETHER):
                texts = b.column(1).slice(at, TOGETHER).to_pylist()
                got += ix.scores(texts) if ix else [(0.0, [])] * len(texts)
            cols = [b.column(k) for k in range(b.num_columns) if keep_text or k != 1]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.list_(pa.int64()))], names=[*(f.name for f in rest), "score", "evidence"])

    return own.mapInArrow(run, schema)


def score_of(spark: SparkSession, index: Index | None, text: Column) -> Column:
    """The score of a text column. Only texts go to the workers and only scores come
    back; all other columns stay where they are."""
    shared = spark.sparkContext.broadcast(index)

    def run(texts: pa.Array) -> pa.Array:
        ix = shared.value
        got: list[float] = []
        for at in range(0, len(texts), TOGETHER):
            some = texts.slice(at, TOGETHER).to_pylist()
            got += [s for s, _ in ix.scores(some)] if ix else [0.0] * len(some)
        return pa.array(got, pa.float64())

    return F.arrow_udf(run, "double")(text)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    out = score(docs, index, keep=[held_out().alias("held_out")])
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
