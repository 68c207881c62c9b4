"""Files from their chunks again, whole or in part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.bytes import joined
from cairn.functions.numbers import long
from cairn.model import Damaged


def placed_chunks(entry_chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(path, pos, chunk_id, len, data, start): every chunk of every file with its bytes and place.

    blocks: (id, data).  A missing block leaves data null."""
    rows = entry_chunks.select("path", "pos", "chunk_id", "len").join(blocks.select(F.col("id").alias("chunk_id"), "data"), "chunk_id", "left")
    before = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("len").over(before), long(0)))


def restored(entry_chunks: DataFrame, blocks: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(path, content, missing): files with their chunks' bytes in order; content is null where a chunk is missing,
    or has another length than its record.

    With ``entries``, files without chunks are restored too, as empty ones; without, only files with chunks are known."""
    got = entry_chunks.select("path", "pos", "chunk_id", "len").join(blocks.select(F.col("id").alias("chunk_id"), "data"), "chunk_id", "left")
    good = F.when(F.octet_length("data") == F.col("len"), F.col("data"))
    whole = got.select("path", "pos", good.alias("data")).groupBy("path").agg(joined("data", "pos").alias("content"), F.count_if(F.col("data").isNull()).alias("missing"))
    whole = whole.withColumn("content", F.when(F.col("missing") == 0, F.col("content")))
    if entries is None:
        return whole
    rows = entries.where(~F.col("is_dir")).select("path", "size").join(whole, "path", "left")
    lost = F.when(F.col("missing").isNotNull(), F.col("missing")).otherwise((F.col("size") > 0).cast("bigint"))
    content = F.when(F.col("missing").isNull() & (F.col("size") == 0), F.lit(b"")).otherwise(F.col("content"))
    return rows.select("path", content.alias("content"), lost.alias("missing"))


def slices(entry_chunks: DataFrame, blocks: DataFrame, offset: int, length: int) -> DataFrame:
    """(path, content): bytes [offset, offset + length) of each file, of only the chunks that hold some."""
    before = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = entry_chunks.select("path", "pos", "chunk_id", "len").withColumn("start", F.coalesce(F.sum("len").over(before), long(0)))
    end = offset + length
    needed = rows.where((F.col("start") < end) & (F.col("start") + F.col("len") > offset))
    got = needed.join(blocks.select(F.col("id").alias("chunk_id"), "data"), "chunk_id", "left")
    skip = F.greatest(long(offset) - F.col("start"), long(0))
    take = F.least(F.col("len"), long(end) - F.col("start")) - skip
    part = got.select("path", "pos", F.substring(F.col("data"), (skip + 1).cast("int"), take.cast("int")).alias("part"))
    whole = part.groupBy("path").agg(joined("part", "pos").alias("content"), F.count_if(F.col("part").isNull()).alias("missing"))
    return whole.select("path", F.when(F.col("missing") == 0, F.col("content")).alias("content"))


def checked(files: DataFrame) -> DataFrame:
    """Restored files, or an error if any lacks a chunk."""
    if not files.where("missing > 0").isEmpty():
        raise Damaged("chunks are missing")
    return files.drop("missing")


def _folder(root: str, parts: list[str]) -> str:
    """The folder of those parts under the root, made where it is missing."""
    import os

    if any(p in ("", ".", "..") for p in parts) or any("\0" in p for p in parts):
        raise ValueError(f"{'/'.join(parts)!r} leaves the target folder")
    at = root
    os.makedirs(root, exist_ok=True)
    for p in parts:
        at = os.path.join(at, p)
        os.makedirs(at, exist_ok=True)
        if os.path.islink(at):
            raise ValueError(f"{at!r} is a link")
    return at


def write_directories(folders: DataFrame, root: str) -> None:
    """Make the directories (path) under ``root``, a folder that all executors share."""
    folders.select("path").foreachPartition(lambda rows: [_folder(root, r["path"].split("/")) for r in rows] and None)


def write_files(files: DataFrame, root: str) -> None:
    """Write (path, content) under ``root``, a folder that all executors share.

    Every path must stay inside it; no component may be a link; an existing file is an error."""

    def write(rows):
        import os

        for r in rows:
            *above, name = r["path"].split("/")
            if name in ("", ".", "..") or "\0" in name:
                raise ValueError(f"{r['path']!r} leaves the target folder")
            target = os.path.join(_folder(root, above), name)
            with os.fdopen(os.open(target, os.O_WRONLY | os.O_CREAT | os.O_EXCL | getattr(os, "O_NOFOLLOW", 0), 0o644), "wb") as out:
                out.write(bytes(r["content"] or b""))

    files.select("path", "content").foreachPartition(write)
