from pyspark.sql import functions as F

import corpus_pipeline
from lakewright.llm import op3_minhash, op6_pii
from lakewright.llm.common import cut


def test_stages(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("*", "1 as score", "2 as lang_pred", "3 as base")
    odd = spark.createDataFrame([(None, "sentence without an id in it"), (900001, None), (900002, ""), (900003, "12 !!"), (900004, "very nice words here"), (900004, "very nice words here")], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    names = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, d), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == names
    labels = spark.read.parquet(f"{d}/labels.parquet")
    first = seen["language"]
    assert first.where("doc_id in (900001, 900002, 900003)").count() == 0 and first.count() == 1000 + 3
    second = seen["toxicity"]
    clean = labels.where("toxic = 0")
    assert first.join(clean, "doc_id").count() - second.join(clean, "doc_id").count() <= 0.02 * clean.count()
    third = seen["near_duplicates"]
    assert third.where("doc_id = 900004").count() == 1 and third.where("doc_id is null").count() == 1
    assert op3_minhash.near_duplicates(third).where("not kept").count() == 0
    fourth = seen["personal_data"]
    assert fourth.count() == third.count() and fourth.where("n_chars <> length(text)").count() == 0
    left = op6_pii.find(fourth).selectExpr("sum(size(base.email) + size(base.ip) + size(base.card) + size(base.phone))").first()[0]
    assert left == 0
    packed = seen["packing"]
    assert packed.select("doc_id").distinct().count() == fourth.select("doc_id").distinct().count()


def stages(spark, docs, d="/root/testdata/sf0.001"):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = cut(stage(spark, docs, d), name)
    return out


def test_rows_are_kept_by_id_and_text(spark):
    a, b, c = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen", "quite another text that nobody else has here"
    rows = [(1, a, "en"), (2, a, "en"), (2, b, "en"), (3, c, "en"), (None, a, None), (None, "text without an id of its own here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == sorted([("1", a), ("2", b), ("3", c), ("None", rows[5][1])])


def test_empty_table_and_long_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    none = stages(spark, docs.limit(0))
    assert all(df.count() == 0 for df in none.values())
    words = " ".join(f"word{i}" for i in range(120_000))
    rows = [(700_001, words, None, "s", len(words)), (700_002, words.upper(), None, "s", len(words)), (700_003, "call 555-123-4567 " + "x" * 1_000_000, None, "s", 1_000_018), (None, None, None, None, None), (700_004, "", None, None, 0)]
    got = stages(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)))
    third, fourth = got["near_duplicates"], got["personal_data"]
    assert [r["doc_id"] for r in third.where("doc_id in (700001, 700002)").collect()] == [700_001]
    assert fourth.where("doc_id = 700003").first()["text"].startswith("call [phone] xxx")
    assert fourth.where("n_chars <> length(text)").count() == 0
    ids = got["packing"].where("doc_id = 700001").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).first()
    assert ids["n"] == ids["m"] > 120_000
    bins = got["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert bins.where("n > 1024 or n <> end").count() == 0
