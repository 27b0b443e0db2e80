"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, as a table, and all but the last return rows with
the columns of documents. Null texts and texts without a letter end with the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import decontaminate, langid, neardups, packing, secrets
from tidewater.llm.common import written

#: The least probability, among the languages, of the one that a document is taken for.
LEAST_SCORE = 0.5


def _row(docs: DataFrame):
    """A document's own columns as one, whatever their names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def _own(docs: DataFrame, **changed) -> list:
    """A document's columns out of _row, some of them changed."""
    return [changed.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns]


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents as _row, beside doc_id and text, with a _key of their own: rows that share a
    doc_id, or have none, may differ in text."""
    return docs.select(_row(docs), F.xxhash64("doc_id", "text").alias("_key"), "doc_id", "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language; where lang is null it becomes the one found."""
    found = langid.with_language(docs.select(_row(docs), "text"), langid.train(docs))
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SCORE))
    return kept.select(_own(docs, lang=F.coalesce("_row.lang", "lang_pred")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, that with the smallest doc_id, and one of rows equal
    in doc_id and text; rows without doc_id stay."""
    keyed = _keyed(docs).filter("doc_id is not null")
    groups = neardups.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"))
    groups = groups.select(F.col("doc_id").alias("_key"), "component_id").distinct()
    first = F.min(F.struct("doc_id", "_key")).alias("first")
    kept = groups.join(keyed.select("_key", "doc_id"), "_key").groupBy("component_id").agg(first).select("first._key")
    one = keyed.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select(_own(docs))
    return one.unionByName(docs.filter("doc_id is null"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with any window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = _keyed(docs)
    found = decontaminate.contamination(keyed.select(F.col("_key").alias("doc_id"), "text"), benchmark)
    found = found.filter("contaminated").select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(found, "_key", "left_anti").select(_own(docs))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret by a mark and counts the characters anew."""
    found = secrets.scan(docs.select(_row(docs), "doc_id", "text"))
    found = found.withColumn("text", secrets.redacted(F.col("text"), F.col("spans")))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.size("spans") > 0, length).otherwise(F.col("_row.n_chars"))
    return found.select(_own(docs, **changed))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("secret_scan", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language ID can't be put in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None
