"""Hierarchical language identification.

First a linear model predicts the language family, then one-versus-one linear
support vector machines vote among the family's languages. Features are the
1-, 2- and 3-grams of the lower-cased whole text's letters as UTF-8 bytes, hashed
to DIM counts, square-rooted and scaled to length one.

The model is fitted on PER_LANG distinct labelled texts of each language at most (a
documented bound), those of least hash; copies of a text count once, so a group of
copies of any size takes one place. Languages are never dropped. Two scans of the
labelled rows give the model, however many languages there are. A text that is null
or has no letter is `und` with score 0. If no row is labelled every text is `und`.
A text under several languages is an example of each. Repeated rows repeat; an
empty table gives an empty result. Further columns are carried under names that
clash with none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

DIM = 2048
#: Most distinct texts of a language that the model is fitted on.
PER_LANG = 400
#: Times PER_LANG of a language's texts that are ranked by hash, the hashes' range,
#: and the languages up to which their bounds are broadcast.
MARGIN, SPACE, MANY = 2.0, 1 << 40, 10_000
UNKNOWN = "und"
# Families of closely related languages; any other language is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl no sv",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg cs hr mk pl ru sk sl sr uk",
    "indic": "bn gu hi mr ne pa ur",
}
_FAMILY = {c: f for f, codes in FAMILIES.items() for c in codes.split()}
_LETTER = re.compile(r"[^\W\d_]")
_CLASS = np.full(256, 32, np.uint32)
_CLASS[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLASS[0x80:] = np.arange(0x80, 0x100)
#: Bytes of a text that are counted at a time.
PART = 1 << 20


def features(text: str) -> np.ndarray:
    """DIM counts of a whole text, scaled to length one."""
    raw, total = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8), np.zeros(DIM)
    for at in range(0, len(raw), PART):
        b = _CLASS[raw[max(0, at - 2): at + PART]]
        if not at:
            b = np.concatenate(([32, 32], b)).astype(np.uint32)
        one, two, three = b[2:], b[1:-1], b[:-2]
        words = one != 32
        h1 = one[words]
        h2 = (one + two * np.uint32(257))[words | (two != 32)]
        h3 = (one + two * np.uint32(257) + three * np.uint32(66049))[words | (two != 32)]
        for salt, h in enumerate((h1, h2, h3)):
            mixed = (h + np.uint32(salt * 0x9E3779B9 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            total += np.bincount((mixed >> np.uint32(13)) % np.uint32(DIM), minlength=DIM)
    x = np.sqrt(total)
    return x / max(np.sqrt(x @ x), 1e-12)


def greatest(x: np.ndarray, rounds: int = 60) -> float:
    """A little above the greatest eigenvalue of x.T @ x, by power iteration."""
    v = np.ones(x.shape[1]) / np.sqrt(x.shape[1])
    top = 0.0
    for _ in range(rounds):
        v = x.T @ (x @ v)
        top = float(np.sqrt(v @ v))
        v /= max(top, 1e-300)
    return 1.05 * top


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 200) -> np.ndarray:
    """Weights (bias last) of a linear machine with squared hinge loss; y is +-1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * len(y)
    lam = 1.0 / (c * len(x))
    step = 1.0 / (lam + 2 * weight.max() * greatest(x) / len(x))
    w = v = np.zeros(x.shape[1])
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (lam * v - 2 * x.T @ (weight * slack * y) / len(x))
        v, w = new + t / (t + 3) * (new - w), new
    return w


def fit_scale(margin: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities: a logistic fit to
    smoothed targets by Newton steps, halved until the loss falls."""
    u = np.ones(len(y)) if weight is None else weight
    n1, n0 = float(u[y > 0].sum()), float(u[y < 0].sum())
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    ab = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])

    def loss(v: np.ndarray) -> float:
        z = v[0] * margin + v[1]
        return float((u * (np.logaddexp(0, z) - t * z)).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(ab[0] * margin + ab[1], -30, 30)))
        g = np.array([(u * (p - t) * margin).sum(), (u * (p - t)).sum()])
        if np.abs(g).max() < 1e-6:
            break
        r = u * p * (1 - p)
        h = np.array([[(r * margin * margin).sum() + 1e-9, (r * margin).sum()], [(r * margin).sum(), r.sum() + 1e-9]])
        d, step, now = np.linalg.solve(h, g), 1.0, loss(ab)
        while step > 1e-10 and loss(ab - step * d) > now - 1e-4 * step * float(g @ d):
            step /= 2
        if step <= 1e-10:
            break
        ab = ab - step * d
    return float(min(max(ab[0], 0.05), 50)), float(ab[1])


class Hierarchy:
    """Families one against the rest, languages of a family one against one."""

    def __init__(self, x: np.ndarray, lang: list[str]):
        self.langs = sorted(set(lang))
        lang_of = np.array(lang)
        fam_of = np.array([_FAMILY.get(c, c) for c in lang])
        self.families = sorted(set(fam_of.tolist()))
        self.members = {f: [c for c in self.langs if _FAMILY.get(c, c) == f] for f in self.families}

        def machine(rows: np.ndarray, y: np.ndarray):
            w = fit_svm(rows, y)
            m = rows @ w[:-1] + w[-1]
            return w, *fit_scale(m, y)

        self.family = [machine(x, np.where(fam_of == f, 1.0, -1.0)) for f in self.families] if len(self.families) > 1 else []
        self.pair = {}
        for f in self.families:
            for i, p in enumerate(self.members[f]):
                for q in self.members[f][i + 1:]:
                    rows = (lang_of == p) | (lang_of == q)
                    self.pair[p, q] = machine(x[rows], np.where(lang_of[rows] == p, 1.0, -1.0))

    @staticmethod
    def _prob(m, x: np.ndarray) -> np.ndarray:
        w, a, b = m
        return 1 / (1 + np.exp(-np.clip(a * (x @ w[:-1] + w[-1]) + b, -30, 30)))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        fam = np.stack([self._prob(m, x) for m in self.family], 1) if self.family else np.ones((len(x), 1))
        best = fam.argmax(1)
        share = fam[np.arange(len(x)), best] / fam.sum(1)
        names, scores = np.empty(len(x), object), np.zeros(len(x))
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            if not len(rows):
                continue
            codes = self.members[f]
            votes, conf = np.zeros((len(rows), len(codes))), np.zeros((len(rows), len(codes)))
            for (p, q), m in self.pair.items():
                if p in codes:
                    pr = self._prob(m, x[rows])
                    i, j = codes.index(p), codes.index(q)
                    votes[:, i] += pr >= 0.5
                    votes[:, j] += pr < 0.5
                    conf[:, i] += pr
                    conf[:, j] += 1 - pr
            top = (votes + conf / (2 * len(codes))).argmax(1)
            names[rows] = [codes[t] for t in top]
            scores[rows] = share[rows] * (conf[np.arange(len(rows)), top] / max(len(codes) - 1, 1) if len(codes) > 1 else 1)
        return names.tolist(), np.clip(scores, 0, 1)


def _usable(t: str | None) -> bool:
    return bool(t) and _LETTER.search(t) is not None


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Hierarchy | None:
    """The model of the rows of labelled that have a text and a language."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    # distinct texts of each language, within a few hundredths
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.05).alias("n")).collect()}
    if not counts:
        return None
    # the PER_LANG texts of least hash: of those under a bound that about MARGIN times as many are under
    of = rows.sparkSession.createDataFrame([(k, int(min(1.0, MARGIN * PER_LANG / n) * SPACE)) for k, n in counts.items()], "lang string, bound long")
    drawn = rows.withColumn("place", F.pmod(F.xxhash64("h"), F.lit(SPACE))).join(F.broadcast(of) if len(counts) <= MANY else of, "lang").where("place < bound")
    drawn = drawn.groupBy("lang", "place", "h").agg(F.min("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place", "h"))
    chosen = drawn.withColumn("nth", nth).where(F.col("nth") <= PER_LANG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(c.as_py(), features(t.as_py()).astype(np.float32).tobytes()) for c, t in zip(b.column(0), b.column(1), strict=True) if _usable(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.binary())], names=["lang", "x"])

    got = chosen.select("lang", "text").mapInArrow(run, "lang string, x binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    return Hierarchy(np.stack([np.frombuffer(r["x"], np.float32) for r in got]).astype(np.float64), [r["lang"] for r in got]) if got else None


def predict(df: DataFrame, model: Hierarchy | None, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None, keep_text: bool = False) -> DataFrame:
    """(id, kept columns, lang_pred, score) of every row of df, and its text as
    __text if keep_text."""
    own = df.select(F.col(id_col), F.col(text_col).alias("__text"), *(keep or []))
    rest = [f for f in own.schema.fields if keep_text or f.name != "__text"]
    schema = T.StructType([*rest, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(1)
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for at in range(0, len(texts), 256):
                some = [(i, t) for i in range(at, min(at + 256, len(texts))) if _usable(t := texts[i].as_py())]
                if some and m is not None:
                    got, conf = m.predict(np.stack([features(t) for _, t in some]))
                    for (i, _), g, s in zip(some, got, conf, strict=True):
                        names[i], scores[i] = g, s
            cols = [b.column(k) for k in range(b.num_columns) if keep_text or k != 1]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*(f.name for f in rest), "lang_pred", "score"])

    return own.mapInArrow(run, schema)


def language_of(spark: SparkSession, model: Hierarchy | None, text: Column) -> Column:
    """The predicted language of a text column. Only texts go to the workers and only
    languages come back; all other columns stay where they are."""
    shared = spark.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        names = [UNKNOWN] * len(texts)
        for at in range(0, len(texts), 256):
            some = [(at + i, t) for i, t in enumerate(texts.slice(at, 256).to_pylist()) if _usable(t)]
            if some and shared.value is not None:
                for (i, _), g in zip(some, shared.value.predict(np.stack([features(t) for _, t in some]))[0], strict=True):
                    names[i] = g
        return pa.array(names, pa.string())

    return F.arrow_udf(run, "string")(text)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    out = predict(docs, model, keep=[held_out().alias("held_out")])
    return out.select("doc_id", "held_out", "lang_pred", "score")
