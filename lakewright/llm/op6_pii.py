"""Personal data by candidate gradient boosting, native.

Base spans are the four fixed patterns with their checks; they always stay. High-recall
generators, several of each kind and often overlapping, propose further spans: addresses
with spelt-out or spaced signs, eight-group and shortened addresses, defanged ones, card
numbers that fail their check, grouped or not, numbers without or with a doubled country
code. Boosted trees score every candidate by its format and context; they are fitted on
generated texts that went through these generators, and a threshold for each kind is
calibrated on other such texts (pii_model.py). Along the text, of overlapping candidates
the better one stays, and base spans beat all.

Everything on rows is a column expression: no shuffle, no Python. Patterns are
possessive and anchored to the start of a run, so that they take linear time
and no stack on texts of any length, and match as the plain forms do.

A null or empty text has no spans. Repeated rows repeat; an empty table gives an
empty result. Further columns are carried under names that clash with none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Carried, table
from .native import SPANS, find_all, let, swept
from .pii_model import ANTI, CUES, FEATURES, KINDS, TEXTS, fit, generated, right

BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried; cheap and never too strict.
HINT = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
}
#: Generators: kind, pattern, and what a text must hold for it to be tried.
GENERATORS = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}+(?:(?: ?[\[(](?:dot|DOT)[\])] ?|\.)[A-Za-z0-9-]{2,24}+){1,4}+", r"[\[(](?:at|AT)[\])]"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ (?:at|AT) [A-Za-z0-9-]{1,63}+(?: (?:dot|DOT) [A-Za-z0-9-]{2,24}+){1,3}+", r" (?:at|AT) [A-Za-z0-9-]{1,63}+ (?:dot|DOT) "),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?@ ?[A-Za-z0-9-]{1,63}+(?: ?\. ?[A-Za-z]{2,24}+){1,3}+", r" @|@ "),
    ("ip", r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}+(?![0-9A-Fa-f:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}+:[0-9A-Fa-f]"),
    ("ip", r"(?<![0-9A-Za-z_:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){0,6}+::(?:[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){0,6}+)?(?![0-9A-Za-z_:])", r"[0-9A-Fa-f]::"),
    ("ip", r"(?<![0-9])[0-9]{1,3}+(?:(?: ?[\[(](?:\.|dot)[\])] ?| \. )[0-9]{1,3}+){3}+(?![0-9])", r"[0-9] ?[\[(](?:\.|dot)[\])]|[0-9] \. [0-9]"),
    ("card", r"(?<![0-9])[0-9]{13,19}+(?![0-9])", r"[0-9]{13}"),
    ("card", r"(?<![0-9./-])[0-9]{4}+(?:[ ./-][0-9]{4}){2}[ ./-][0-9]{3,4}+(?![0-9])", r"[0-9]{4}[ ./-][0-9]{4}[ ./-][0-9]{4}"),
    ("card", r"(?<![0-9-])[0-9]{4}+[ -][0-9]{6}[ -][0-9]{5}+(?![0-9-])", r"[0-9]{4}[ -][0-9]{6}[ -]"),
    ("phone", r"(?<![0-9+.(-])\(?[0-9]{2,4}+\)?[ .-][0-9]{3,4}+[ .-][0-9]{3,4}+(?![0-9])", r"[0-9]\)?[ .-][0-9]{3}"),
    ("phone", r"(?<![0-9+.-])\(?0[0-9]{1,4}+\)? ?[/-]? ?[0-9]{2,4}+(?:[ .-]?[0-9]{2,4}+){1,3}+(?![0-9])", r"0[0-9]"),
    ("phone", r"(?<![0-9+.-])00[1-9][0-9]{0,2}+[ .-][0-9]{2,4}+(?:[ .-]?[0-9]{2,7}+){1,3}+(?![0-9])", r"00[1-9]"),
]
#: Code points of context before a candidate.
CONTEXT = 24


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.filter(F.split(F.reverse(d), ""), lambda c: c != ""), lambda c, i: let(c.cast("int") * (1 + i % 2), lambda v: v - F.when(v > 9, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


CHECK = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255")))),
    "card": lambda m: let(digits(m), lambda d: F.length(d).between(13, 19) & luhn(d)),
    "phone": lambda m: F.length(digits(m)).between(9, 15),
}


def base_spans(text: Column, kind: str) -> Column:
    """Checked base spans of one kind, in order."""
    got = F.filter(find_all(text, BASE[kind]), lambda r: CHECK[kind](r["m"]))
    return F.when(HINT[kind](text), got).otherwise(F.array().cast(SPANS))


def tree_sql(tree, names: dict[int, Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, limit, left, right = tree
    return F.when(names[f] <= F.lit(limit), tree_sql(left, names)).otherwise(tree_sql(right, names))


def features(text: Column, kind: str, generator: int, r: Column) -> Column:
    """The model's features of candidate r as a struct."""
    before = F.lower(F.substring(text, F.greatest(r["s"] - CONTEXT + 1, F.lit(1)), F.least(r["s"], F.lit(CONTEXT))))
    word = r"[\p{L}\p{N}_#]"
    d = digits(r["m"])
    last = F.regexp_replace(before, r"[^\p{L}]+$", "")
    cols = {
        "kind": F.lit(KINDS[kind]),
        "generator": F.lit(generator),
        "length": r["e"] - r["s"],
        "digits": F.length(d),
        "seps": F.length(F.regexp_replace(r["m"], "[A-Za-z0-9]", "")),
        "before_word": F.when(r["s"] > 0, F.substring(text, r["s"], F.lit(1)).rlike(word)).otherwise(F.lit(False)).cast("int"),
        "after_word": F.substring(text, r["e"] + 1, F.lit(1)).rlike(word).cast("int"),
        "cue": last.rlike(r"\b(?:" + "|".join(CUES) + r")(?: is)?$").cast("int"),
        "anti": last.rlike(r"\b(?:" + "|".join(ANTI) + r")(?: no)?$").cast("int"),
        "luhn": F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)).cast("int"),
        "distinct": F.size(F.array_distinct(F.filter(F.split(d, ""), lambda c: c != ""))),
        "groups": F.size(F.split(r["m"], "[^A-Za-z0-9]+")),
        "first": F.coalesce(F.substring(d, 1, 1).try_cast("int"), F.lit(-1)),
        "parts": F.forall(F.split(r["m"], "[^0-9]+"), lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255"))).cast("int"),
        "marks": F.length(F.regexp_replace(r["m"], r"[^\[\]()@]", "")),
        "space_before": F.when(r["s"] > 0, F.substring(text, r["s"], F.lit(1)).rlike(r"[\s(:,]")).otherwise(F.lit(True)).cast("int"),
        "letters": F.length(F.regexp_replace(r["m"], "[^A-Za-z]", "")),
    }
    return F.struct(*(cols[n].cast("double").alias(n) for n in FEATURES))


def candidates(text: Column, generator: int) -> Column:
    """A generator's candidates as array<struct<s, e, m>>."""
    _, pattern, hint = GENERATORS[generator]
    return F.when(text.rlike(hint), find_all(text, pattern)).otherwise(F.array().cast(SPANS))


_model: list = []


def model(spark: SparkSession) -> tuple[list, list[float]]:
    """Trees and thresholds, fitted once on generated texts that go through the
    generators and features as all texts do. The driver holds TEXTS texts' features."""
    if not _model:
        texts = generated(TEXTS, 7)
        df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, text string")
        x, y, unseen = [], [], []

        def told(g: int) -> Column:
            return F.transform(candidates(F.col("text"), g), lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e"), features(F.col("text"), GENERATORS[g][0], g, r).alias("f")))

        rows = df.select("i", *(told(g).alias(f"g{g}") for g in range(len(GENERATORS))))
        for r in sorted(rows.collect(), key=lambda r: r["i"]):
            for g, (kind, _, _) in enumerate(GENERATORS):
                for c in r[f"g{g}"]:
                    x.append(tuple(c["f"]))
                    y.append(right(kind, c["s"], c["e"], texts[r["i"]][1]))
                    unseen.append(r["i"] % 2 == 1)
        _model.append(fit(np.array(x), np.array(y, float), np.array(unseen)))
    return _model[0]


SPAN = "struct<s:int,e:int,p:double,kind:string>"
#: The score of base spans, which beat every candidate.
BEST = 1e9


def accepted(text: Column, generator: int, trees: list, limits: list[float]) -> Column:
    """A generator's candidates that reach their kind's threshold, as array<SPAN>."""
    kind = GENERATORS[generator][0]

    def scored(r: Column) -> Column:
        def total(f: Column) -> Column:
            out = F.lit(0.0)
            for t in trees:
                out = out + tree_sql(t, {i: f[n] for i, n in enumerate(FEATURES)})
            return out

        return F.struct(r["s"].alias("s"), r["e"].alias("e"), let(features(text, kind, generator, r), total).alias("p"), F.lit(kind).alias("kind"))

    return F.filter(F.transform(candidates(text, generator), scored), lambda r: r["p"] >= F.lit(limits[KINDS[kind]]))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, kept columns, base, added) of every row: base is a struct of span
    arrays by kind, added an array<struct<s, e, p, kind>> of the method's spans, in order."""
    trees, limits = model(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = df.select(F.col(id_col), *(keep or []), text.alias("__text"), *(base_spans(text, k).alias(f"__{k}") for k in BASE), F.flatten(F.array(*(accepted(text, g, trees, limits) for g in range(len(GENERATORS))))).alias("__more"))
    taken = F.concat(*(F.transform(tagged(F.col(f"__{k}"), k), lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e"), F.lit(BEST).alias("p"), r["kind"].alias("kind"))) for k in BASE))
    # along the text, of two that overlap the better one stays; base spans merge
    over = lambda c, r: r["s"] < c["e"]
    whole = lambda c, r: F.struct(c["s"].alias("s"), F.greatest(c["e"], r["e"]).alias("e"), c["p"].alias("p"), c["kind"].alias("kind"))
    better = lambda c, r: F.when(r["p"] > c["p"], r).when((r["p"] == c["p"]) & (c["p"] == BEST), whole(c, r)).otherwise(c)
    every = F.array_sort(F.concat(taken, F.col("__more")).cast(f"array<{SPAN}>"))
    added = F.filter(swept(every, SPAN, over, better), lambda r: r["p"] < BEST)
    return first.select(id_col, *(keep or []), "__text", F.struct(*(F.col(f"__{k}").alias(k) for k in BASE)).alias("base"), F.when(F.size("__more") > 0, added).otherwise(F.array().cast(f"array<{SPAN}>")).alias("added"))


def tagged(rows: Column, kind: str) -> Column:
    return F.transform(rows, lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e"), F.lit(kind).alias("kind")))


def of_kind(rows: Column, kind: str) -> Column:
    return F.filter(rows, lambda r: r["kind"] == kind)


def spelt(kind: str, rows: Column) -> Column:
    return F.transform(rows, lambda r: F.concat(F.lit(kind + ":"), r["s"].cast("string"), F.lit(":"), r["e"].cast("string")))


#: Spans whose surroundings are cut from a text together.
TOGETHER = 64


def replaced(text: Column, rows: Column) -> Column:
    """text with its sorted, separate spans (s, e, kind) replaced by kinds in brackets.
    A text is walked once for each block of spans, then only the block's part of it."""

    def blocks(z: Column) -> Column:
        end = lambda i: F.when(i > 0, F.get(z, i - 1)["e"]).otherwise(F.lit(0))

        def one(b: Column) -> Column:
            lo = end(b * TOGETHER)
            hi = F.get(z, F.least((b + 1) * TOGETHER, F.size(z)) - 1)["e"]
            own = F.sequence(b * TOGETHER, F.least((b + 1) * TOGETHER, F.size(z)) - 1)
            return let(F.substring(text, lo + 1, hi - lo), lambda part: F.array_join(F.transform(own, lambda i: F.concat(F.substring(part, end(i) - lo + 1, F.get(z, i)["s"] - end(i)), F.lit("["), F.get(z, i)["kind"], F.lit("]"))), ""))

        parts = F.transform(F.sequence(F.lit(0), ((F.size(z) - 1) / TOGETHER).cast("int")), one)
        return F.concat(F.array_join(parts, ""), F.substring(text, end(F.size(z)) + 1, F.length(text)))

    return F.when(F.size(rows) == 0, text).otherwise(let(rows, blocks))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with every span of a row's text replaced by its kind in brackets, in
    the text column; a null text stays null. Overlapping spans become one, of the
    first one's kind."""
    carried = Carried(df, id_col, text_col)
    got = find(df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__src"), *carried.keep(), F.col(text_col).isNull().alias("__null")), "__id", "__src", keep=[*carried.alias.values(), "__null"])
    kind = "struct<s:int,e:int,kind:string>"
    rows = F.array_sort(F.concat(*(tagged(F.col("base")[k], k) for k in BASE), F.transform("added", lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e"), r["kind"].alias("kind")))).cast(f"array<{kind}>"))
    apart = swept(rows, kind, lambda c, r: r["s"] < c["e"], lambda c, r: F.struct(c["s"].alias("s"), F.greatest(c["e"], r["e"]).alias("e"), c["kind"].alias("kind")))
    text = F.when(F.col("__null"), F.lit(None)).otherwise(replaced(F.col("__text"), F.when(F.size(rows) > 1, apart).otherwise(rows)))
    return carried.restore(got.withColumn("__new", text), **{id_col.lower(): "__id", text_col.lower(): "__new"})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find(table(spark, sf_dir, "documents"))
    base = F.concat(*(spelt(k, F.col("base")[k]) for k in BASE))
    both = F.concat(*(spelt(k, F.array_sort(F.concat(tagged(F.col("base")[k], k), tagged(of_kind(F.col("added"), k), k)))) for k in BASE))
    return got.select("doc_id", *(F.size(F.col("base")[k]).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"), F.concat_ws(",", both).alias("spans"), F.size("added").cast("long").alias("n_added"))
