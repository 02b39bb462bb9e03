"""Corpus pipeline: language ID, line dedup, near-duplicate removal, PII redaction, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``. Counted as part of the ``llm`` subpackage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm import language, line_dedup, packing, pii, simhash
from graphlens.llm.common import bounded_batches, shared_folder


def _again(docs: DataFrame, text: DataFrame) -> DataFrame:
    """``text`` with the columns of ``docs`` in their order; n_chars follows the text."""
    if "n_chars" in docs.columns:
        text = text.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return text.select(docs.columns)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with null text or no letter at all, and sets ``lang`` to the predicted language.

    Where no labelled row is left to learn from, ``lang`` stays as it is.
    """
    bounded_batches(spark)
    labelled = docs.where(~language.held_out(F.col("doc_id")))
    model = language.fit(labelled)
    if not model.langs:  # every text would be 'und'
        return language.with_letters(docs)
    kept = language.predict(docs, model, names=("__lang", "__score", "__spans")).where("__lang <> 'und'")
    if "lang" in docs.columns:
        kept = kept.withColumn("lang", F.col("__lang"))
    return kept.select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes line chunks and passages that occur earlier; a document left without any letter or digit goes."""
    bounded_batches(spark)
    return _again(docs, line_dedup.remove_repeats(docs, count="__removed", passage_words=50).where(F.coalesce(F.col("text").rlike(r"[\p{L}\p{N}]"), F.lit(False))))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of similar documents the one with the smallest id.

    A group's rows that share that id keep the text of the smallest hash, and of
    rows alike in id and text one stays; different texts under one id that are
    in different groups all stay; rows without an id belong to no group.
    """
    bounded_batches(spark)
    groups = simhash.similar_components(docs).where("doc_id = component_id")
    kept = groups.groupBy("component").agg(F.min(F.struct("text_hash", "doc_id")).alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.text_hash").alias("__hash"))
    rows = docs.select(F.col("doc_id").alias("__id"), F.xxhash64(F.col("text").cast("string")).alias("__hash"), F.struct(*(f"`{c}`" for c in docs.columns)).alias("__row"))
    named = rows.join(kept, ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"])
    return named.select("__row.*").unionAll(docs.where("doc_id is null"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets."""
    return _again(docs, pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    bounded_batches(spark)
    return packing.digest(packing.pack(docs, *packing.public_paths()))


STAGES = [
    ("language", identify),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("pii", redact),
    ("packing", pack),
]

#: SQL can't express the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, written and read again in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for n, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{n}-{name}")
        docs = spark.read.parquet(f"{where}/{n}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
