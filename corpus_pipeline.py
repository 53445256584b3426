"""A training corpus in five stages, each on all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm import op3_minhash, op4_language, op6_pii, op7_packing, op9_toxicity
from lakewright.llm.common import cut, table


#: Most rows that a Python worker gets at once: whole texts may be long.
BATCH = 2000


def bounded(spark: SparkSession) -> None:
    """Keeps the batches in which whole texts pass small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that no language can be told of: null, empty and letterless
    texts. Every other text is in the nearest learned language and stays, repeated
    rows and null ids included; without any labelled row all stay."""
    bounded(spark)
    model = op4_language.fit(docs.where(~op4_language.held_out()))
    if model is None:
        return docs
    return docs.where(op4_language.language_of(spark, model, F.col("text")) != op4_language.UNKNOWN)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score is 0.5 or more. Null and empty texts have the
    prior's score, so they stay; repeated rows fare alike; without labels all stay."""
    bounded(spark)
    labels = table(spark, sf_dir, "labels").where(~op9_toxicity.held_out())
    index = op9_toxicity.fit(docs, labels)
    return docs.where(op9_toxicity.score_of(spark, index, F.col("text")) < 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, that of the least id (null
    last). Rows are told apart by id and text: an id under two texts is two rows,
    equal rows are one. Rows with null, empty or wordless texts are in no group and
    stay, repeats included."""
    bounded(spark)
    return op3_minhash.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; n_chars follows the text. Every row
    stays; null texts stay null, and their n_chars with them."""
    out = op6_pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of 1024 tokens. A null or empty text has its
    closing id alone; repeated rows are packed each."""
    bounded(spark)
    return op7_packing.pack(docs)


STAGES = [("language", language), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packing)]

#: Models, signatures and encoders are beyond SQL; tests/llm hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
