"""The catalogue as text, an entry a row: what leaves an archive, and what comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.model import ENTRIES, MAX_BLOCK
from cairn.operators import codec, parity
from cairn.sources import sidecar


def lines(entries: DataFrame, entry_chunks: DataFrame) -> DataFrame:
    """(path, json): each entry with the list of its chunks, in order."""
    lists = entry_chunks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))).alias("c"))
    rows = entries.join(lists, "path", "left")
    modified = F.col("modified") if "modified" in entries.columns else F.lit(None).cast("string")
    chunks = F.coalesce(F.transform("c", lambda x: x["chunk_id"]), F.array().cast("array<string>"))
    body = F.struct("path", "size", modified.alias("modified"), "is_dir", chunks.alias("chunks"), F.lit(None).cast("bigint").alias("pack_offset"))
    return rows.select("path", F.to_json(body).alias("json"))


def parsed(rows: DataFrame, json: str = "json") -> DataFrame:
    """Entries (with their lists of chunks) from their lines; a line that is none, or too long, is a row of nulls."""
    return rows.select(F.from_json(F.when(F.octet_length(json) <= MAX_BLOCK, F.col(json)), ENTRIES).alias("e")).select("e.*")


def sealed(json: Column, key: bytes, path: Column) -> Column:
    """A line encrypted, bound to its path."""
    return F.aes_encrypt(F.encode(json, "UTF-8"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.encode(path, "UTF-8"))


def opened(data: Column, key: bytes, path: Column) -> Column:
    return F.decode(codec.decrypted(data, F.lit(key), F.encode(path, "UTF-8")), "UTF-8")


def regions(headers: DataFrame, manifests: DataFrame) -> DataFrame:
    """(path, content) of the regions of files that parity of their metadata covers: ``#header`` and ``#manifest`` of each (path, content)."""
    name = lambda rows, tag: rows.select(F.concat("path", F.lit(tag)).alias("path"), "content")
    return name(headers, "#header").unionByName(name(manifests, "#manifest"))


def protected(rows: DataFrame, pct: int, window: int) -> DataFrame:
    """(path, sidecar) of regions."""
    return sidecar.build(rows, pct, window)


def healed(rows: DataFrame, sidecars: DataFrame, pct: int, window: int) -> DataFrame:
    """(path, content, status, rebuilt) of regions by their sidecars."""
    return sidecar.repair(rows, sidecars, pct, window)


def empty_sidecars(paths: DataFrame, pct: int, window: int) -> DataFrame:
    """Sidecars of files (path) that have no bytes yet."""
    parity.grid_of(pct)
    return sidecar.build(paths.select("path", F.lit(b"").alias("content")), pct, window)
