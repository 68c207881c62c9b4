"""The corpus pipeline: five stages, each an operator of ``cairn.llm`` over all that is left.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read
again as the next one's docs.  All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, linededup, mixing, near, quality
from cairn.llm._shared import id_bucket, table, written

#: Tokens that the mixing stage keeps, of all, and how far it evens out each marginal (1: as found).
KEEP, TEMPERATURES = 0.8, {"source": 0.7, "lang": 0.8, "topic": 0.9}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of label 1 is at least quality.THRESHOLD; texts are not changed."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), usable=id_bucket("doc_id", 5) != 0)
    scored = quality.with_score(docs, model, name="_quality")
    return scored.where(F.col("_quality") >= quality.THRESHOLD).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of recurring templates; n_chars follows the text."""
    left = linededup.drop_recurring(docs, dropped="_dropped")
    return left.withColumn("n_chars", F.when(F.col("_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id.

    If ids repeat or are null, rows are numbered first, and the smallest number of a group stays."""
    columns = docs.columns
    docs, key = near.numbered(docs)
    others = near.near_copies(docs, key).where(F.col(key) != F.col("component_id")).select(F.col(key).alias("_gone"))
    return docs.join(others, F.col(key) == F.col("_gone"), "left_anti").select(*columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of documents, raked to source, language and topic; each row is kept or not by its own probability."""
    return mixing.sample(docs, TEMPERATURES, KEEP)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian 32 bits) and digests of ids and decoded bytes."""
    encoded = bpe.encode(docs, *bpe.default_files(), carried=["lang", "source"])
    return bpe.digests(encoded, more=["lang", "source", "ids"])


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: SQL can express neither the classifier nor the hashes; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
