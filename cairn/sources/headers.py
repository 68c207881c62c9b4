"""Fixed headers of archive files: built, read without a password, and authenticated, by expressions.

Layout (little-endian): 0 magic (10 bytes), 10 version, 11 flags (1: plaintext), 12 data offset, 20 data
length, 28 manifest offset, 36 manifest length, 44 extension offset, 52 extension length, 60 zeros,
448 HMAC-SHA512 over the header with these 64 bytes zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.bytes import hmac_sha512, read_le, write_le

MAGIC, SIZE, MAC_AT = b"CAIRNARCH1", 512, 448
FIELDS = {"data_offset": 12, "data_len": 20, "manifest_offset": 28, "manifest_len": 36, "extension_offset": 44, "extension_len": 52}


def _body(version: Column, flags: Column, fields: dict[str, Column]) -> Column:
    byte = lambda c: F.unhex(F.lpad(F.hex(c.cast("bigint")), 2, "0"))
    head = F.concat(F.lit(MAGIC), byte(version), byte(flags), *[write_le(fields[f]) for f in FIELDS])
    return F.rpad(head, MAC_AT, F.lit(b"\0"))


def header(key: bytes, version: Column, flags: Column, **fields: Column) -> Column:
    body = _body(version, flags, fields)
    return F.concat(body, F.unhex(hmac_sha512(key, F.concat(body, F.lit(bytes(64))))))


def is_archive(content: Column) -> Column:
    return F.coalesce((F.substring(content, 1, len(MAGIC)) == F.lit(MAGIC)) & (read_le(content, 10, 1) == 1), F.lit(False))


def is_authentic(content: Column, key: bytes) -> Column:
    mac = hmac_sha512(key, F.concat(F.substring(content, 1, MAC_AT), F.lit(bytes(64))))
    return F.coalesce(F.lower(F.hex(F.substring(content, MAC_AT + 1, 64))) == mac, F.lit(False))


def peek(content: Column) -> dict[str, Column]:
    """Version, flags and sections of a header that nothing has authenticated."""
    out = {"version": read_le(content, 10, 1).cast("int"), "plaintext": read_le(content, 11, 1).cast("int").bitwiseAND(F.lit(1)) == 1}
    return out | {name: read_le(content, at, 8) for name, at in FIELDS.items()}


def peek_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, is_archive, version, ...) of the files under a directory."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    head = F.substring("content", 1, SIZE)
    return rows.select("path", "length", is_archive(head).alias("is_archive"), *[F.when(is_archive(head), c).alias(n) for n, c in peek(head).items()])
