"""Integrity of stored blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.bytes import block_hash


def scrub(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, block_index, problem) of damaged chunks.

    chunks: (id, block_index, data_offset, block_len, cipher_hash); blocks: (id, block) as read."""
    rows = chunks.join(blocks.select("id", "block"), "id", "left")
    problem = (
        F.when(F.col("block").isNull(), "missing")
        .when(F.octet_length("block") != F.col("block_len"), "length")
        .when(block_hash(F.col("block")) != F.col("cipher_hash"), "hash")
    )
    return rows.select("id", "block_index", problem.alias("problem")).where("problem IS NOT NULL")


def damaged_entries(damaged: DataFrame, entry_chunks: DataFrame) -> DataFrame:
    """(path, pos, id, problem): where damaged chunks are used."""
    return entry_chunks.join(damaged.select(F.col("id").alias("chunk_id"), "problem"), "chunk_id").select("path", "pos", F.col("chunk_id").alias("id"), "problem")


def parity_source(found: DataFrame) -> DataFrame:
    """(file, source): explicit before sidecar before embedded, ``none`` without any.

    found: (file, explicit, sidecar, embedded) as booleans."""
    best = F.when(F.col("explicit"), "explicit").when(F.col("sidecar"), "sidecar").when(F.col("embedded"), "embedded").otherwise("none")
    return found.select("file", best.alias("source"))


def binding_problems(sidecars: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem) of sidecars (path, binding_id, content_sha256, total_len) against (path, content)."""
    from cairn.functions.bytes import binding_id

    rows = sidecars.join(files.select("path", "content"), "path", "left")
    problem = (
        F.when(F.col("binding_id") != binding_id(F.col("content_sha256")), "inconsistent")
        .when(F.col("content").isNull(), "no file")
        .when(F.octet_length("content") != F.col("total_len"), "length")
        .when(F.sha2("content", 256) != F.col("content_sha256"), "content")
    )
    return rows.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def corrupted(files: DataFrame, at: int, flip: int = 0x5A) -> DataFrame:
    """Files with one byte changed, for drills; those too short stay as they are."""
    c = F.col("content")
    byte = F.conv(F.hex(F.substring(c, at + 1, 1)), 16, 10).cast("int")
    changed = F.concat(F.substring(c, 1, at), F.unhex(F.lpad(F.hex(byte.bitwiseXOR(F.lit(flip)).cast("bigint")), 2, "0")), F.substr(c, F.lit(at + 2)))
    return files.withColumn("content", F.when(F.octet_length(c) > at, changed).otherwise(c))
