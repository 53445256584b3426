import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewright.llm import op4_language, op9_toxicity
from lakewright.llm.common import table

SAMPLES = {"en": "the cat and the dog were with this that thing", "de": "der hund und die katze sind nicht schön über", "fr": "le chat et la souris être dans une forêt où", "es": "el perro y los gatos más allá del niño señor"}


def labelled(spark, n=60):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(SAMPLES[c].split()) for _ in range(30)), c) for i, c in enumerate(sorted(SAMPLES) * n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language(spark):
    df = labelled(spark)
    model = op4_language.fit(df.where("doc_id % 3 <> 0"))
    got = op4_language.predict(df, model, keep=[F.col("lang")]).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (None, "le chat et la"), (5, "é" * 300_000), (5, "der " * 50_000), (5, "der " * 50_000)], "doc_id long, text string").selectExpr("*", "1 as lang_pred", "2 as score")
    got = op4_language.predict(odd, model).collect()
    assert [r["lang_pred"] for r in got][:3] == ["und"] * 3 and [r["score"] for r in got][:3] == [0.0] * 3
    assert len(got) == 7 and got[5]["lang_pred"] == got[6]["lang_pred"] == "de"


def test_language_without_labels(spark):
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert op4_language.fit(none) is None
    assert [r["lang_pred"] for r in op4_language.predict(none, None).collect()] == ["und"]
    one = op4_language.fit(spark.createDataFrame([(1, "abc", "xx")], "doc_id long, text string, lang string"))
    assert [r["lang_pred"] for r in op4_language.predict(none, one).collect()] == ["xx"]
    assert op4_language.predict(none.limit(0), one).count() == 0


def test_language_of_many_copies_is_learned(spark):
    copies = spark.range(60_000).selectExpr("id as doc_id", "'el perro y los gatos mas alla' as text", "'es' as lang")
    rng = random.Random(5)
    english = spark.createDataFrame([(i, " ".join(rng.choice(SAMPLES["en"].split()) for _ in range(20)), "en") for i in range(500)], "doc_id long, text string, lang string")
    model = op4_language.fit(copies.unionByName(english))
    assert model.langs == ["en", "es"]
    few = op4_language.fit(copies.limit(3000).unionByName(copies.limit(40).selectExpr("doc_id", "concat(text, doc_id) as text", "lang")).unionByName(english))
    assert few.langs == ["en", "es"]


def test_features_in_parts(monkeypatch):
    text = "Straße über alles, déjà vu! " * 40
    whole = op4_language.features(text)
    monkeypatch.setattr(op4_language, "PART", 64)
    assert np.allclose(whole, op4_language.features(text))


def test_language_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = op4_language.query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    held = out.where("held_out")
    assert held.count() > 200
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def toxic_docs(spark, n=400):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(n):
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnr')}" for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            words[7:7] = rng.sample(["vileness", "vilely", "vilest", "scumbag", "scummy"], 3)
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = toxic_docs(spark)
    ix = op9_toxicity.fit(docs, labels.where("doc_id % 4 <> 1"))
    got = op9_toxicity.score(docs, ix).join(labels, "doc_id").where("doc_id % 4 = 1").collect()
    assert np.mean([(r["score"] >= 0.5) == bool(r["toxic"]) for r in got]) > 0.95
    assert all(r["evidence"] for r in got if r["toxic"])


def test_index_equals_full_scan(spark):
    docs, labels = toxic_docs(spark)
    ix = op9_toxicity.fit(docs, labels)
    full = np.zeros((ix.n, len(ix.term)))
    for e in range(ix.n):
        t, w = ix.example(e)
        full[e, t] = w
    rng = random.Random(4)
    for trial in range(60):
        t = np.array(sorted(rng.sample(range(len(ix.term)), min(rng.choice([2, 5, 60]), len(ix.term)))))
        w = np.array([rng.random() + 0.1 for _ in t])
        w /= np.sqrt(w @ w)
        cos = np.round(full[:, t] @ w, 12)
        want = sorted((e for e in range(ix.n) if cos[e] > 0), key=lambda e: (-cos[e], ix.tie[e]))[: op9_toxicity.K]
        got, best, extra = ix.nearest(t, w, ix.depend[t])
        assert np.allclose(got, cos[want], atol=1e-9) and best.tolist() == want, trial
        assert np.allclose(extra, full[best][:, t] @ (w * ix.depend[t]))


def test_every_term_of_every_example_is_indexed(spark):
    docs, labels = toxic_docs(spark)
    ix = op9_toxicity.fit(docs, labels)
    words = {w for r in docs.collect() for w in op9_toxicity.terms(r["text"])}
    assert set(ix.term) == words and ix.n == docs.select("text").distinct().count()


def test_copy_of_an_example_with_rare_words_finds_its_twin(spark):
    docs, labels = toxic_docs(spark, 100)
    odd = "quaint zebra vortex gnome thimble walnut orchid"
    docs, labels = docs.unionByName(spark.createDataFrame([(1000, odd)], docs.schema)), labels.unionByName(spark.createDataFrame([(1000, 1)], labels.schema))
    ix = op9_toxicity.fit(docs, labels)
    got = op9_toxicity.score(spark.createDataFrame([(1, odd), (2, odd + " lamp"), (3, "unheard of words")], docs.schema), ix).collect()
    assert got[0]["score"] >= 0.5 and got[1]["score"] >= 0.5 and got[0]["evidence"][0] == 1000
    assert got[2]["score"] < 0.5 and got[2]["evidence"] == []


def test_toxicity_of_copies_and_ids_in_conflict(spark):
    docs, labels = toxic_docs(spark, 100)
    many = docs.where("doc_id = 1").selectExpr("explode(sequence(2000, 6999)) as doc_id", "text")
    ix = op9_toxicity.fit(docs.unionByName(many.selectExpr("cast(doc_id as long) doc_id", "text")), labels.unionByName(many.selectExpr("cast(doc_id as long) doc_id", "0 as toxic")))
    assert ix.n == docs.select("text").distinct().count()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_toxicity_held_out_labels(spark, sf):
    d = f"/root/testdata/{sf}"
    got = op9_toxicity.query(spark, d).where("held_out").join(table(spark, d, "labels"), "doc_id").select("toxic", "predicted").collect()
    bad, clean = [r for r in got if r["toxic"]], [r for r in got if not r["toxic"]]
    assert sum(r["predicted"] for r in bad) >= (0.9 if len(bad) > 20 else 0.6) * len(bad)
    assert sum(r["predicted"] for r in clean) <= 0.01 * len(clean)


def test_toxicity_edges(spark):
    docs, labels = toxic_docs(spark, 200)
    odd = spark.createDataFrame([(None, "x"), (1, None), (2, ""), (3, "vilest " * 60_000), (4, "bal"), (4, "bal")], "doc_id long, text string").selectExpr("*", "1 as score", "2 as evidence")
    ix = op9_toxicity.fit(docs, labels)
    got = op9_toxicity.score(odd, ix).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got) and got[4]["score"] == got[5]["score"]
    assert got[1]["score"] == got[2]["score"] < 0.5
    assert op9_toxicity.fit(docs, labels.limit(0)) is None
    assert [r["score"] for r in op9_toxicity.score(docs.limit(2), None).collect()] == [0.0, 0.0]
    one_sided = op9_toxicity.fit(docs, labels.where("toxic = 0"))
    assert all(r["score"] < 0.5 for r in op9_toxicity.score(docs, one_sided).collect())
    twice = labels.unionByName(labels.selectExpr("doc_id", "cast(null as int) as toxic")).unionByName(labels.limit(3))
    assert op9_toxicity.fit(docs, twice).n > 0


@pytest.mark.parametrize("y,margin", [(np.array([1.0, -1, 1, -1]), np.array([2.0, -2, 1, -1])), (np.array([-1.0, -1]), np.array([0.0, 0]))])
def test_scale_is_monotone(y, margin):
    a, _ = op4_language.fit_scale(margin, y)
    assert a > 0
