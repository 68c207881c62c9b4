"""Detached parity of a file: a small binary that finds its own way when it is damaged itself.

Layout (little-endian): 8 magic, 1 version, then the number of segments three times (4 bytes each), then the
directory three times, each followed by its SHA-256, then the segments' payloads.  A directory holds
8 total length, 32 binding id, 32 SHA-256 of the content, and for each segment 8 window offset, 8 window
length, 8 payload length and a copy of the payload's 32-byte header.  Version 1 has one number and one directory, and
a SHA-256 of all before it at the end: nothing in it heals.

A payload is a header (2 data shards a group, 2 parity shards a group, 4 shard size, 8 window length, 8 data shards,
8 groups), 16 bytes of checksum for each data shard and then each parity shard, and the parity shards.

A sidecar is built where its file's windows are cut; reading one looks at its head alone, and a payload is cut out
of the rest only when its file is to be mended."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import numbers
from cairn.functions.batches import cells, handed
from cairn.functions.bytes import read_le
from cairn.functions.numbers import long
from cairn.model import WINDOW, Damaged
from cairn.operators import parity

MAGIC, VERSION, OLD = b"CAIRNSID", 2, 1
#: Bytes of a directory without segments and of a segment in it, of a hash; copies; and the most bytes of a directory.
FIXED, LOCATOR, HASH, COPIES, MOST = 72, 56, 32, 3, 64 << 20
#: A payload's header, and its bytes.
GEOMETRY, GEOMETRY_LEN = "<HHIQQQ", 32
SUFFIX = ".cairnside"
SIDECARS = "path string, sidecar binary"
LOCATORS = "path string, idx bigint, window_offset bigint, window_len bigint, parity_offset bigint, payload_len bigint, geometry binary, segments bigint, total_len bigint, binding_id string, content_sha256 string, healed boolean, problem string"


def sidecar_path(path: Column) -> Column:
    return F.concat(path, F.lit(SUFFIX))


def candidate_counts(counts: list[int]) -> list[int]:
    """Numbers of segments worth trying: one that two copies agree on first, then the others, each once."""
    often = [c for c in counts if counts.count(c) > 1]
    return list(dict.fromkeys(often + counts))


def longest_payload(window_len: int) -> int:
    """The most bytes that a window's payload may have: those at the highest overhead."""
    k, p = parity.grid_of(numbers.MOST_PCT)
    if window_len == 0:
        return 0
    shard = min(max(-(-window_len // k), numbers.LEAST_SHARD), numbers.MOST_SHARD)
    shards = -(-window_len // shard)
    groups = -(-shards // k)
    return numbers.HEADER + numbers.CHECKSUM * (shards + p * groups) + p * groups * shard


# Payloads


def encode_payload(data: bytes, k: int, p: int) -> bytes:
    """The payload of a window; none for no bytes."""
    if not data:
        return b""
    grid = parity._window_shards(data, k)
    real, groups = -(-len(data) // grid.shape[1]), len(grid) // k
    extra = [parity.encode_group(grid[g * k : min((g + 1) * k, real)], p, k) for g in range(groups)]
    made = np.concatenate(extra)
    digest = lambda x: hashlib.sha256(x.tobytes()).digest()[: numbers.CHECKSUM]
    head = struct.pack(GEOMETRY, k, p, grid.shape[1], len(data), real, groups)
    return b"".join([head, *(digest(x) for x in grid[:real]), *(digest(x) for x in made), made.tobytes()])


def decode_payload(payload: bytes, window_len: int) -> list[tuple]:
    """(grp, slot, is_parity, checksum in hexadecimal, bytes of parity or None); an error unless all its numbers fit each other and its length."""
    if not window_len and not payload:
        return []
    if len(payload) < GEOMETRY_LEN or len(payload) > longest_payload(window_len):
        raise Damaged("payload of a wrong length")
    k, p, shard, length, shards, groups = struct.unpack_from(GEOMETRY, payload)
    right = length == window_len and k >= 2 and p >= 1 and 0 < shard <= numbers.MOST_SHARD and shards == -(-length // shard) and groups == -(-shards // k)
    if not right or len(payload) != GEOMETRY_LEN + numbers.CHECKSUM * (shards + p * groups) + p * groups * shard:
        raise Damaged("payload geometry")
    sums = payload[GEOMETRY_LEN : GEOMETRY_LEN + numbers.CHECKSUM * (shards + p * groups)]
    digest = lambda i: sums[i * numbers.CHECKSUM : (i + 1) * numbers.CHECKSUM].hex()
    body = payload[len(payload) - p * groups * shard :]
    out = [(i // k, i % k, False, digest(i), None) for i in range(shards)]
    return out + [(j // p, k + j % p, True, digest(shards + j), body[j * shard : (j + 1) * shard]) for j in range(p * groups)]


# Building


def _assembled(total: int, sha: bytes, window: int, payloads: list[bytes], version: int) -> bytes:
    """The sidecar of a file of ``total`` bytes from the payloads of its windows."""
    rows = (struct.pack("<QQQ", i * window, min(window, total - i * window), len(x)) + x[:GEOMETRY_LEN].ljust(GEOMETRY_LEN, b"\0") for i, x in enumerate(payloads))
    directory = b"".join([struct.pack("<Q", total), hashlib.sha256(b"cairn-sidecar-v1" + sha).digest(), sha, *rows])
    head, number = MAGIC + bytes([version]), struct.pack("<I", len(payloads))
    if version == OLD:
        body = b"".join([head, number, directory, *payloads])
        return body + hashlib.sha256(body).digest()
    return b"".join([head, number * COPIES, (directory + hashlib.sha256(directory).digest()) * COPIES, *payloads])


def build(files: DataFrame, pct: int, window: int = WINDOW, version: int = VERSION) -> DataFrame:
    """(path, sidecar) of (path, content).

    A file's windows come to its task one after the other, and what they give stays there: nothing is shuffled."""
    k, p = parity.grid_of(pct)
    heads = [F.octet_length("content").cast("bigint").alias("total"), F.unhex(F.sha2("content", 256)).alias("sha")]
    windows = parity.cut_windows(files.where("path IS NOT NULL"), window, heads)

    def sidecars(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[bytes] = []
        for path, total, sha, win, data in (row for b in batches for row in cells(b)):
            if win != len(held):
                raise RuntimeError("windows of a file are out of order")
            held.append(encode_payload(data, k, p))
            if (win + 1) * window >= total:
                yield path, _assembled(total, sha, window, held, version)
                held = []

    return windows.mapInArrow(lambda batches: handed(sidecars(batches), SIDECARS), SIDECARS)


# Reading


def _voted(copies: list[bytes]) -> bytes:
    a, b, c = (np.frombuffer(x, np.uint8) for x in copies)
    return np.where((a == b) | (a == c), a, np.where(b == c, b, a)).astype(np.uint8).tobytes()


def _tries(parts: list[bytes], size: int) -> Iterator[tuple[bytes, bytes]]:
    """Directories with hashes: the copies, then, if it comes to that, their vote with each hash and with the hashes' vote."""
    yield from ((p[:size], p[size:]) for p in parts)
    voted, sums = _voted([p[:size] for p in parts]), [p[size:] for p in parts]
    yield from ((voted, s) for s in [*sums, _voted(sums)])


def _parsed(directory: bytes, n: int, size: int, start: int) -> list[tuple]:
    """Rows of the directory; an error unless they bind, tile the content and fill what follows."""
    total = int.from_bytes(directory[:8], "little")
    bound, sha = directory[8:40], directory[40:72]
    if hashlib.sha256(b"cairn-sidecar-v1" + sha).digest() != bound:
        raise Damaged("binding")
    rows, at, offset = [], 0, start
    for i in range(n):
        base = FIXED + i * LOCATOR
        w_offset, w_len, p_len = (int.from_bytes(directory[base + 8 * j : base + 8 * j + 8], "little") for j in range(3))
        if w_offset != at or p_len > longest_payload(w_len) or (w_len == 0 and total):
            raise Damaged("windows")
        rows.append((i, w_offset, w_len, offset, p_len, directory[base + 24 : base + LOCATOR], n, total, bound.hex(), sha.hex()))
        at, offset = at + w_len, offset + p_len
    if at != total or offset != size:
        raise Damaged("length")
    return rows


def locate(data: bytes, length: int | None = None) -> tuple[list[tuple], bool]:
    """(rows of the directory, whether anything had to be healed) of a sidecar; an error if no reading of it is consistent.

    ``data`` may be its head (see :func:`head`) if ``length`` says how many bytes it has."""
    length = len(data) if length is None else length
    if data[: len(MAGIC)] != MAGIC or len(data) < len(MAGIC) + 1:
        raise Damaged("no sidecar")
    at = len(MAGIC) + 1
    if data[at - 1] == OLD:
        n = int.from_bytes(data[at : at + 4], "little")
        start = at + 4 + FIXED + n * LOCATOR
        if start + HASH > len(data) or hashlib.sha256(data[:-HASH]).digest() != data[-HASH:]:
            raise Damaged("checksum")
        return _parsed(data[at + 4 : start], n, len(data) - HASH, start), False
    if data[at - 1] != VERSION:
        raise Damaged("version")
    counts = [int.from_bytes(data[at + 4 * i : at + 4 * i + 4], "little") for i in range(COPIES)]
    at += 4 * COPIES
    for n in candidate_counts(counts):
        size = FIXED + n * LOCATOR
        start = at + COPIES * (size + HASH)
        if size > MOST or start > length:
            continue
        parts = [data[at + i * (size + HASH) : at + (i + 1) * (size + HASH)] for i in range(COPIES)]
        for directory, digest in _tries(parts, size):
            if hashlib.sha256(directory).digest() == digest:
                try:
                    rows = _parsed(directory, n, length, start)
                except Damaged:
                    continue
                return rows, len(set(counts)) > 1 or any(p != directory + digest for p in parts)
    raise Damaged("no copy of the directory holds")


def head(data: Column) -> Column:
    """As much of a sidecar as :func:`locate` looks at: whole in version 1, else up to the end of the longest directory that its numbers allow."""
    at, length = len(MAGIC) + 1, F.octet_length(data).cast("bigint")
    starts = []
    for i in range(COPIES):
        size = read_le(data, at + 4 * i, 4).cast("bigint") * LOCATOR + FIXED
        start = (size + HASH) * COPIES + at + 4 * COPIES
        starts.append(F.when((size <= MOST) & (start <= length), start).otherwise(long(at + 4 * COPIES)))
    return F.when(F.substring(data, at, 1) == F.lit(bytes([VERSION])), F.substr(data, F.lit(1), F.greatest(*starts).cast("int"))).otherwise(data)


def read(sidecars: DataFrame) -> DataFrame:
    """A row (see LOCATORS) for each segment of (path, sidecar); one with a problem for a sidecar that cannot be read."""

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for path, data, length in (row for b in batches for row in cells(b)):
            try:
                found, healed = locate(data or b"", length or 0)
                yield from ((path, *r, healed, None) for r in found)
            except Damaged as e:
                yield (path, *[None] * 11, str(e))

    rows = sidecars.select("path", head(F.col("sidecar")).alias("head"), F.octet_length("sidecar").cast("bigint").alias("length"))
    return rows.mapInArrow(lambda batches: handed(located(batches), LOCATORS), LOCATORS)


def _windows(data: bytes, rows: list[tuple]) -> dict[int, parity.Window]:
    """Shards of located segments.  A payload whose header differs from the directory's copy is read with the copy; one that fits neither gives none."""
    out: dict[int, parity.Window] = {}
    for idx, _, length, offset, n, geometry, *_ in rows:
        payload = data[offset : offset + n]
        if payload and payload[:GEOMETRY_LEN] != geometry:
            payload = geometry + payload[GEOMETRY_LEN:]
        try:
            got = decode_payload(payload, length)
        except Damaged:
            continue
        if got:
            out[idx] = {(grp, slot): (ck, raw) for grp, slot, _, ck, raw in got}
    return out


def flags(located: DataFrame) -> DataFrame:
    """(path, segments, parity_bytes, healed, problem): one row a sidecar."""
    first = F.first("problem", ignorenulls=True)
    return located.groupBy("path").agg(F.count_if(F.col("problem").isNull()).alias("segments"), F.coalesce(F.sum("payload_len"), long(0)).alias("parity_bytes"), F.coalesce(F.max("healed"), F.lit(False)).alias("healed"), first.alias("problem"))


def repair(files: DataFrame, sidecars: DataFrame, pct: int, window: int = WINDOW, anchor: DataFrame | None = None) -> DataFrame:
    """(path, content, status, rebuilt) of (path, content) by their sidecars (path, sidecar).

    The hash that a repaired file must have is the sidecar's, or that of ``anchor`` (path, sha256) where trust comes from elsewhere:
    a sidecar of another content then repairs nothing."""
    rows = files.select("path", "content")
    if anchor is not None:
        rows = rows.join(anchor.select("path", "sha256"), "path").join(sidecars.select("path", F.col("sidecar").alias("kept")), "path", "left")
    else:
        rows = rows.join(sidecars.select("path", F.col("sidecar").alias("kept")), "path").withColumn("sha256", F.lit(None).cast("string"))

    own_hash = anchor is None  # a frame may not go to the tasks

    def found(sha: str | None, kept: pa.Scalar):
        data = kept.as_buffer().to_pybytes() if kept.is_valid else b""
        try:
            segments = locate(data)[0]
        except Damaged:
            segments = []
        if own_hash:
            return (segments[0][9], lambda: _windows(data, segments)) if segments else None
        return sha, lambda: _windows(data, segments)

    return parity.mended(rows, found, pct, window)
