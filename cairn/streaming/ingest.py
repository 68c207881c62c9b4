"""Ingest as a stream: rows become files, chunks and blocks as they arrive.

There is no event time: a file is a row, and its chunks follow from it alone, so cutting is
stateless.  Files that come in pieces are cut by a chunker whose state is the open chunk and the pieces
that came too early."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairn.model import Bounds
from cairn.operators import chunking
from cairn.operators.archive import Archive
from cairn.sources.rows import files_of_rows
from cairn.sources.store import Store


def stream_files(spark: SparkSession, folder: str, schema: str, path, content, per_trigger: int = 100) -> DataFrame:
    """Files of the rows of Parquet files that appear in a folder."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return files_of_rows(rows, path, content)


def stream_chunks(files: DataFrame, size: int) -> DataFrame:
    """A streaming frame of the chunks of streaming files."""
    return chunking.entry_chunks(files, size)


def opened(store: Store, size: int, key: bytes | None = None) -> Archive:
    """The archive in a store, made if there is none."""
    return Archive(store, size, key=key) if store.current() is not None else Archive.create(store, size, key=key)


def ingest_batch(store: Store, files: DataFrame, size: int, key: bytes | None = None) -> int:
    """Add files (path, content) to the archive as one commit: see :meth:`Archive.add`.

    A batch that comes again after a failure finds its files there and replaces them by equal ones; their chunks are there
    already and are not stored again."""
    return opened(store, size, key).add(files)


def ingest_stream(files: DataFrame, store: Store, size: int, checkpoint: str, key: bytes | None = None):
    """Start a query that ingests every micro-batch as one commit."""

    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            ingest_batch(store, batch, size, key)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_gear_chunks(pieces: DataFrame, bounds: Bounds) -> DataFrame:
    """(path, pos, start, len, chunk_id) of files that arrive as (path, seq, data, last), seq from 0, whatever the pieces.

    Pieces are fed in order of seq, also over micro-batches: one that comes before its turn is kept in the state until those
    before it are there, and one that comes again is ignored.  The state is the open chunk, at most the largest size, and what waits.
    A file ends, and its state goes, when all up to its last piece have been fed."""
    bounds.checked()

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pos, start, due, held, end, seqs, waiting = state.get if state.exists else (0, 0, 0, b"", -1, [], [])
        early = dict(zip(seqs, waiting))
        for f in frames:
            for seq, data, last in zip(f["seq"], f["data"], f["last"]):
                if seq >= due:
                    early.setdefault(int(seq), bytes(data))
                if last:
                    end = int(seq)
        chunker = chunking.Chunker(bounds)
        out = list(chunker.feed(bytes(held)))  # the open chunk has no cut in it: its state is made anew
        while due in early:
            out += chunker.feed(early.pop(due))
            due += 1
        done = 0 <= end < due
        if done:
            out += chunker.finish()
            state.remove()
        starts = [start + sum(map(len, out[:i])) for i in range(len(out))]
        if not done:
            state.update((pos + len(out), start + sum(map(len, out)), due, bytes(chunker.open), end, list(early), list(early.values())))
        yield pd.DataFrame({"path": [key[0]] * len(out), "pos": range(pos, pos + len(out)), "start": starts, "len": [len(c) for c in out], "chunk_id": [hashlib.sha256(c).hexdigest()[:32] for c in out]})

    kept = "pos bigint, start bigint, due bigint, held binary, last bigint, seqs array<bigint>, waiting array<binary>"
    return pieces.groupBy("path").applyInPandasWithState(step, "path string, pos bigint, start bigint, len bigint, chunk_id string", kept, "append", GroupStateTimeout.NoTimeout)
