"""Recovery data: Reed-Solomon parity over shards of files, and repair.

A file is protected in windows.  A window's bytes are cut into shards of one size (the last padded
with zeros), K shards and P parity shards make a group, every shard has a checksum.  A shard whose
checksum fails is an erasure; up to P erasures of a group can be computed again.  Groups are
independent: they are the unit of parallel work.

The code is systematic over GF(256) with the polynomial 0x11D and a Cauchy matrix, so any K of K + P
shards suffice."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import numbers
from cairn.functions.batches import cells, handed
from cairn.functions.numbers import ceil_div, long
from cairn.model import WINDOW

CHECK_DIGITS = 32


@cache
def _field() -> tuple[np.ndarray, np.ndarray]:
    exp, log = np.zeros(512, dtype=np.uint8), np.zeros(256, dtype=np.int64)
    x = 1
    for i in range(255):
        exp[i], log[x] = x, i
        x = x << 1 ^ (0x11D if x & 0x80 else 0)
    exp[255:510] = exp[:255]
    return exp, log


@cache
def _products() -> np.ndarray:
    """[a, b] -> a * b."""
    exp, log = _field()
    a = np.arange(256)
    out = exp[(log[a][:, None] + log[a][None, :]) % 255]
    out[0, :] = out[:, 0] = 0
    return out


def inverse(a: int) -> int:
    exp, log = _field()
    return int(exp[(255 - log[a]) % 255])


@cache
def matrix(k: int, p: int) -> np.ndarray:
    """[p, k]: 1 / (x_i + y_j) with distinct x and y."""
    return np.array([[inverse((k + i) ^ j) for j in range(k)] for i in range(p)], dtype=np.uint8)


@cache
def _tables() -> list[bytes]:
    """For each a, the products a * b as a table that bytes are translated by."""
    return [row.tobytes() for row in _products()]


def _times(rows: np.ndarray, shards: Sequence[np.ndarray]) -> np.ndarray:
    """Matrix times shards over the field; a table look-up a coefficient, none for a shard of zeros."""
    tables = _tables()
    out = np.zeros((len(rows), len(shards[0])), dtype=np.uint8)
    for column, shard in zip(rows.T.tolist(), shards):
        if not shard.any():
            continue
        raw = shard.tobytes()
        for i, c in enumerate(column):
            if c:
                out[i] ^= np.frombuffer(raw.translate(tables[c]), np.uint8)
    return out


def encode_group(shards: np.ndarray, p: int, k: int | None = None) -> np.ndarray:
    """The parity shards of [k, size] data shards, of which the last may be left out if they are zeros."""
    return _times(matrix(k or len(shards), p)[:, : len(shards)], shards)


@lru_cache(maxsize=4096)
def _inverted(use: tuple[int, ...], k: int, p: int) -> np.ndarray:
    """[k, k]: what the shards ``use`` are multiplied by to give the data shards."""
    rows = np.zeros((k, 2 * k), dtype=np.uint8)
    rows[:, k:] = np.eye(k, dtype=np.uint8)
    for r, i in enumerate(use):
        rows[r, :k] = np.eye(k, dtype=np.uint8)[i] if i < k else matrix(k, p)[i - k]
    table = _products()
    for c in range(k):  # Gauss-Jordan
        pivot = next(r for r in range(c, k) if rows[r, c])
        rows[[c, pivot]] = rows[[pivot, c]]
        rows[c] = table[inverse(int(rows[c, c]))][rows[c]]
        for r in range(k):
            if r != c and rows[r, c]:
                rows[r] ^= table[rows[r, c]][rows[c]]
    return rows[:, k:]


def solve_group(shards: list[np.ndarray | None], k: int, p: int) -> list[np.ndarray] | None:
    """The k data shards from k + p shards of which some are lost; None if more than p are."""
    have = [i for i, s in enumerate(shards) if s is not None]
    if len(have) < k:
        return None
    if all(s is not None for s in shards[:k]):
        return list(shards[:k])
    use = have[:k]
    lost = [i for i in range(k) if shards[i] is None]
    found = _times(_inverted(tuple(use), k, p)[lost], [shards[i] for i in use])
    out = list(shards[:k])
    for i, s in zip(lost, found):
        out[i] = s
    return out


def checksum(shard: bytes) -> str:
    return hashlib.sha256(shard).hexdigest()[:CHECK_DIGITS]


def layout(files: DataFrame, pct: int, window: int = WINDOW) -> DataFrame:
    """(path, idx, window_offset, window_len, k, p, shard, shards, groups): every window's grid."""
    n = F.col("size")
    k, p = numbers.grid(long(pct))
    rows = files.select("path", F.explode(numbers.windows(n, window)).alias("w")).select("path", "w.*")
    rows = rows.withColumn("k", k).withColumn("p", p)
    g = numbers.geometry(F.col("window_len"), F.col("k"))
    return rows.select("*", *[c.alias(name) for name, c in g.items()])


def data_shards(files: DataFrame, pct: int, window: int = WINDOW) -> DataFrame:
    """(path, win, grp, slot, cksum, len): data shards of (path, content, size) by expressions alone.

    All is cut inside arrays before anything is exploded, so no row carries its file's bytes along.  Bytes beyond a
    window's end count as zeros in the checksum."""
    k, _ = numbers.grid(long(pct))
    content = F.col("content")

    def shards_of(w: Column) -> Column:
        g = numbers.geometry(w["window_len"], k)

        def one(i: Column) -> Column:
            size = F.least(g["shard"], w["window_len"] - i * g["shard"])
            data = F.substring(content, (w["window_offset"] + i * g["shard"] + 1).cast("int"), size.cast("int"))
            padded = F.rpad(data, g["shard"].cast("int"), F.lit(b"\0"))
            return F.struct(w["idx"].alias("win"), numbers.div(i, k).alias("grp"), (i % k).alias("slot"), F.substring(F.sha2(padded, 256), 1, CHECK_DIGITS).alias("cksum"), size.alias("len"))

        return F.transform(F.sequence(long(0), g["shards"] - 1), one)

    full = F.filter(numbers.windows(F.col("size"), window), lambda w: w["window_len"] > 0)
    return files.select("path", F.explode(F.flatten(F.transform(full, shards_of))).alias("s")).select("path", "s.*")


def cut_windows(files: DataFrame, window: int, more: list[Column] | None = None) -> DataFrame:
    """(path, win, data): the windows of (path, content), cut before they are exploded; a file's come one after the other.

    ``more`` columns go between path and win."""
    more = more or []
    parts = F.transform(
        numbers.windows(F.octet_length("content").cast("bigint"), window),
        lambda w: F.struct(w["idx"].alias("win"), F.substring(F.col("content"), (w["window_offset"] + 1).cast("int"), w["window_len"].cast("int")).alias("data")),
    )
    rows = files.select("path", *more, F.explode(parts).alias("w"))
    return rows.select(*rows.columns[:-1], "w.win", "w.data")


def _window_shards(data: bytes, k: int) -> np.ndarray:
    """[group * k, size]: a window as whole groups of padded shards."""
    size = min(max(-(-len(data) // k), numbers.LEAST_SHARD), numbers.MOST_SHARD)
    groups = -(-(-(-len(data) // size)) // k)
    return np.frombuffer(data.ljust(groups * k * size, b"\0"), dtype=np.uint8).reshape(groups * k, size)


def grid_of(pct: int | None) -> tuple[int, int]:
    """The integers of numbers.grid, for work outside expressions."""
    pct = min(max(pct if pct is not None else numbers.DEFAULT_PCT, numbers.LEAST_PCT), numbers.MOST_PCT)
    p = 1 if pct < 10 else 2
    return max(2, (p * 100 + pct // 2) // pct), p


SHARDS = "path string, win bigint, grp bigint, slot bigint, is_parity boolean, cksum string, bytes binary"


def protect(files: DataFrame, pct: int, window: int = WINDOW) -> DataFrame:
    """Checksums of data shards (without bytes) and parity shards of (path, content).

    Windows are cut in the plan, so a task's work is a window, not a file."""
    k, p = grid_of(pct)
    parts = cut_windows(files, window)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for path, win, data in (row for b in batches for row in cells(b)):
            if not data:
                continue
            grid = _window_shards(data, k)
            real = -(-len(data) // grid.shape[1])
            for g in range(len(grid) // k):
                group = grid[g * k : min((g + 1) * k, real)]
                yield from ((path, win, g, s, False, checksum(x.tobytes()), None) for s, x in enumerate(group))
                yield from ((path, win, g, k + s, True, checksum(x.tobytes()), x.tobytes()) for s, x in enumerate(encode_group(group, p, k)))

    return parts.mapInArrow(lambda batches: handed(shards(batches), SHARDS), SHARDS)


def health(files: DataFrame, shards: DataFrame, pct: int, window: int = WINDOW) -> DataFrame:
    """One row: data and parity shards, how many are damaged, groups, and groups beyond repair.

    Damaged data shards are found by joining the files' shards as they are with the checksums."""
    p = grid_of(pct)[1]
    now = data_shards(files, pct, window).select("path", "win", "grp", "slot", F.col("cksum").alias("found"))
    rows = shards.join(now, ["path", "win", "grp", "slot"], "left")
    alive = F.when(F.col("is_parity"), F.substring(F.sha2("bytes", 256), 1, CHECK_DIGITS)).otherwise(F.col("found"))
    bad = ~F.coalesce(alive == F.col("cksum"), F.lit(False))
    by_group = rows.groupBy("path", "win", "grp").agg(
        F.count_if(~F.col("is_parity")).alias("data"), F.count_if(F.col("is_parity")).alias("parity"),
        F.count_if(bad & ~F.col("is_parity")).alias("bad_data"), F.count_if(bad & F.col("is_parity")).alias("bad_parity"),
    )
    zero = lambda c: F.coalesce(c, long(0))
    return by_group.agg(
        zero(F.sum("data")).alias("total_data_shards"), zero(F.sum("parity")).alias("total_parity_shards"),
        zero(F.sum("bad_data")).alias("damaged_data_shards"), zero(F.sum("bad_parity")).alias("damaged_parity_shards"),
        F.count(F.lit(1)).alias("groups"), F.count_if(F.col("bad_data") > p - F.col("bad_parity")).alias("unrecoverable_groups"),
    )


#: Of a window, (group, slot) -> (checksum, bytes of parity or None).
Window = dict[tuple[int, int], tuple[str, bytes | None]]


def _mended_window(data: bytes, own: Window, k: int, p: int) -> tuple[bytes, int]:
    """A window's bytes with what its shards mend, and how many data shards were computed."""
    grid = _window_shards(data, k)
    size, real = grid.shape[1], -(-len(data) // grid.shape[1])
    out, rebuilt = [], 0
    for g in range(len(grid) // k):
        group: list[np.ndarray | None] = []
        for slot in range(k + p):
            want = own.get((g, slot))
            if slot < k:
                raw = grid[g * k + slot]
                fine = checksum(raw.tobytes()) == want[0] if want is not None else g * k + slot >= real or not raw.any()
                group.append(raw if fine else None)
            else:
                fine = want is not None and want[1] is not None and len(want[1]) == size and checksum(want[1]) == want[0]
                group.append(np.frombuffer(want[1], np.uint8) if fine else None)
        solved = solve_group(group, k, p)
        out += solved if solved is not None else list(grid[g * k : (g + 1) * k])  # beyond repair: as it was
        rebuilt += sum(x is None for x in group[:k]) if solved is not None else 0
    return b"".join(x.tobytes() for x in out)[: len(data)], rebuilt


MENDED = "path string, content binary, status string, rebuilt bigint"


def mended(rows: DataFrame, found: Callable[[str | None, object], tuple[str | None, Callable[[], dict[int, Window]]] | None], pct: int, window: int) -> DataFrame:
    """(path, content, status, rebuilt) of (path, content, sha256, kept), all or nothing a file.

    found(sha256, kept) is the hash that the file must have and how to get the shards of its windows, or None for a file to leave out.
    A row is one file with all that is kept of it, so no bytes move between tasks for what its windows give."""
    k, p = grid_of(pct)

    def one(data: bytes | None, sha: str | None, windows: Callable[[], dict[int, Window]]) -> tuple[bytes | None, str, int]:
        if data is None or sha is None:
            return data, "unrecoverable", 0
        if hashlib.sha256(data).hexdigest() == sha:
            return data, "clean", 0
        known, parts, rebuilt = windows(), [], 0
        for w in range(max(1, -(-len(data) // window))):
            part, own = data[w * window : (w + 1) * window], known.get(w)
            if part and own:
                part, n = _mended_window(part, own, k, p)
                rebuilt += n
            parts.append(part)
        fixed = b"".join(parts)
        good = hashlib.sha256(fixed).hexdigest() == sha
        return fixed if good else data, "repaired" if good else "unrecoverable", rebuilt

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for i, (path, data, sha) in enumerate(cells(b.select([0, 1, 2]))):
                if (got := found(sha, b.column(3)[i])) is not None:
                    yield (path, *one(data, *got))

    return rows.select("path", "content", "sha256", "kept").mapInArrow(lambda batches: handed(files(batches), MENDED), MENDED)


def repair(files: DataFrame, shards: DataFrame, expected: DataFrame, pct: int, window: int = WINDOW) -> DataFrame:
    """(path, content, status, rebuilt) of (path, content), all or nothing a file.

    expected: (path, sha256).  status: ``clean`` if the content has that hash already, ``repaired``
    if it has it after repair, else ``unrecoverable``, and then the content is what it was.  rebuilt: data shards that were
    computed from the others, in all windows."""
    have = shards.groupBy("path").agg(F.collect_list(F.struct("win", "grp", "slot", "cksum", "bytes")).alias("shards"))
    rows = files.select("path", "content").join(expected.select("path", "sha256"), "path").join(have, "path", "left")
    broken = F.sha2("content", 256) != F.col("sha256")

    def found(sha: str | None, kept: pa.Scalar):
        def windows() -> dict[int, Window]:
            out: dict[int, Window] = {}
            for s in kept.as_py() or []:
                out.setdefault(s["win"], {})[s["grp"], s["slot"]] = s["cksum"], s["bytes"]
            return out

        return sha, windows

    return mended(rows.select("path", "content", "sha256", F.when(broken, F.col("shards")).alias("kept")), found, pct, window)


def worth_protecting(files: DataFrame, pct: int, most_overhead_pct: int, cap: int = 1 << 30, window: int = WINDOW) -> DataFrame:
    """(path, size, sidecar_len, decision): too large, too small to be worth its overhead, or protect."""
    size = F.col("size")
    length = numbers.sidecar_len(size, long(pct), window)
    small = (F.lit(most_overhead_pct) > 0) & (length * 100 > size * most_overhead_pct)
    return files.select("path", "size", length.alias("sidecar_len"), F.when(size > cap, "too large").when(small, "not worth it").otherwise("protect").alias("decision"))


def estimated_windows(length: Column, window: int) -> Column:
    return F.greatest(ceil_div(length, window), long(1))
