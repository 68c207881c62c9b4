"""Chunks of files: of fixed size by expressions, or content-defined by a gear hash.

Gear: state = rotate_left(state, 1) + TABLE[byte] modulo 2**64, cut when a chunk has at least the
smallest size and the state's low bits are zero, or at the largest size; the state starts anew after
a cut.  Because the state rotates, all bytes of a chunk bear on its end, so cuts do not fall back
into step after an insertion; equal files and equal prefixes share chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.bytes import chunk_id
from cairn.functions.numbers import ceil_div, long
from cairn.model import Bounds

SEED = b"cairn-gear-v1"
#: Bytes (padded) of the contents that are cut together, and the fewest contents for which that pays.
TOGETHER, FEW = 1 << 26, 16
MASK = (1 << 64) - 1


def fixed_chunks(content: Column, size: int, data: bool = False) -> Column:
    """Array of (pos, start, len, id) of chunks of ``size`` bytes, the last one shorter; none for no bytes.

    Ids are made before anything is exploded, so no row carries its file's bytes along; with ``data`` each carries its own."""
    n = F.octet_length(content).cast("bigint")

    def one(i: Column) -> Column:
        part = F.substring(content, (i * size + 1).cast("int"), F.lit(size))
        own = [part.alias("data")] if data else []
        return F.struct(i.cast("int").alias("pos"), (i * size).alias("start"), F.least(long(size), n - i * size).alias("len"), chunk_id(part).alias("id"), *own)

    return F.when(n > 0, F.transform(F.sequence(long(0), ceil_div(n, size) - 1), one))


def entry_chunks(files: DataFrame, size: int, carried: list[str] | None = None, data: bool = False) -> DataFrame:
    """(path, pos, start, len, chunk_id), and data if asked for: a row for each chunk of each file (path, content)."""
    rows = files.select("path", *(carried or []), F.explode(fixed_chunks(F.col("content"), size, data)).alias("c"))
    own = ["c.data"] if data else []
    return rows.select("path", *(carried or []), "c.pos", "c.start", F.col("c.len").alias("len"), F.col("c.id").alias("chunk_id"), *own)


@cache
def gear_table() -> np.ndarray:
    """256 numbers from a hash of the seed and the byte."""
    return np.array([int.from_bytes(hashlib.sha256(SEED + bytes([i])).digest()[:8], "little") for i in range(256)], dtype=np.uint64)


class Chunker:
    """Cuts a stream of bytes into content-defined chunks, whatever the sizes it comes in.

    Holds the open chunk only: at most the largest size and what was fed last."""

    def __init__(self, bounds: Bounds):
        self.bounds = bounds.checked()
        self.open = bytearray()
        self.state, self.read = 0, 0
        self.table = gear_table().tolist()

    def feed(self, data: bytes) -> Iterator[bytes]:
        b = self.bounds
        self.open += data
        while True:
            cut = self._cut(b.smallest, b.average - 1, b.largest)
            if cut is None:
                return
            yield bytes(self.open[:cut])
            del self.open[:cut]
            self.state, self.read = 0, 0

    def _cut(self, smallest: int, mask: int, largest: int) -> int | None:
        held, table, state = self.open, self.table, self.state
        end = min(len(held), largest)
        # No cut is possible in a chunk's first bytes, but they enter the state.
        for i in range(self.read, min(end, smallest - 1)):
            state = ((state << 1 | state >> 63) + table[held[i]]) & MASK
        for i in range(max(self.read, smallest - 1), end):
            state = ((state << 1 | state >> 63) + table[held[i]]) & MASK
            if not state & mask:
                return i + 1
        if end == largest:
            return largest
        self.state, self.read = state, end
        return None

    def finish(self) -> Iterator[bytes]:
        if self.open:
            yield bytes(self.open)
        self.open = bytearray()
        self.state, self.read = 0, 0


def cuts(data: bytes, bounds: Bounds) -> list[tuple[int, int]]:
    """(start, end) of the chunks of ``data``; one chunk if it has no more than the smallest size."""
    out, at = [], 0
    chunker = Chunker(bounds)
    for part in (*chunker.feed(data), *chunker.finish()):
        out.append((at, at + len(part)))
        at += len(part)
    return out


def cuts_of_many(contents: list[bytes], bounds: Bounds) -> list[list[tuple[int, int]]]:
    """The cuts of each content: as :func:`cuts`, but contents of like length take their steps together, as numpy rows."""
    out: list[list[tuple[int, int]]] = [[] for _ in contents]
    order = sorted(range(len(contents)), key=lambda i: -len(contents[i]))
    at = 0
    while at < len(order):
        n = max(1, min(len(order) - at, TOGETHER // max(1, len(contents[order[at]]))))
        rows = order[at : at + n]
        if n < FEW:
            for i in rows:
                out[i] = cuts(contents[i], bounds)
        else:
            for i, ends in zip(rows, _steps([contents[i] for i in rows], bounds.checked())):
                out[i] = list(zip([0, *ends[:-1]], ends))
        at += n
    return out


def _steps(rows: list[bytes], bounds: Bounds) -> list[list[int]]:
    """Where the chunks of each row end; rows are sorted by length, the longest first."""
    size = np.array([len(r) for r in rows])
    longest = int(size[0])
    cells = np.ascontiguousarray(np.frombuffer(b"".join(r.ljust(longest, b"\0") for r in rows), np.uint8).reshape(len(rows), longest).T)
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # rows longer than t
    table, mask, one, top = gear_table(), np.uint64(bounds.average - 1), np.uint64(1), np.uint64(63)
    state, held = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.int64)
    ends: list[list[int]] = [[] for _ in rows]
    for t in range(longest):
        m = int(active[t])
        s = ((state[:m] << one) | (state[:m] >> top)) + table[cells[t, :m]]
        state[:m] = s
        held[:m] += 1
        for i in np.flatnonzero(((s & mask) == 0) & (held[:m] >= bounds.smallest) | (held[:m] == bounds.largest)).tolist():
            ends[i].append(t + 1)
            state[i], held[i] = 0, 0
    for i in np.flatnonzero(held).tolist():
        ends[i].append(int(size[i]))
    return ends


def gear_chunks(files: DataFrame, bounds: Bounds, data: bool = False) -> DataFrame:
    """(path, pos, start, len, chunk_id), and data if asked for, by content; a file is cut in one task, files in parallel."""
    bounds.checked()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            contents = [cell.as_buffer().to_pybytes() if cell.is_valid else b"" for cell in b.column(1)]
            for path, raw, at in zip(b.column(0).to_pylist(), contents, cuts_of_many(contents, bounds)):
                ids = [hashlib.sha256(raw[s:e]).hexdigest()[:32] for s, e in at]
                cols = [pa.array([path] * len(at), pa.string()), pa.array(range(len(at)), pa.int32()), pa.array([s for s, _ in at], pa.int64()), pa.array([e - s for s, e in at], pa.int64()), pa.array(ids, pa.string())]
                own = [pa.array([raw[s:e] for s, e in at], pa.binary())] if data else []
                yield pa.RecordBatch.from_arrays(cols + own, ["path", "pos", "start", "len", "chunk_id", "data"][: 5 + len(own)])

    return files.select("path", "content").mapInArrow(run, "path string, pos int, start bigint, len bigint, chunk_id string" + (", data binary" if data else ""))
