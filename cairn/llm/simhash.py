"""SimHash near-duplicates: bit-sliced comparison of fingerprints.

A fingerprint bit is 1 if it is 1 in over half of the XXH64 values (seed 42) of a text's word
shingles, repeats included; further 64-bit words of wide fingerprints come from mixing those
values.  Two fingerprints link if they differ in at most ``radius`` bits.

Equal fingerprints become one node first, whatever their number.  Each node is then listed under
its key in several *tables*; a key is the fingerprint under the table's bit mask.  With
``exact_masks`` every link within the radius shares a key in some table (pigeonhole), so none is
lost.  Rows are dealt by key and sorted,
and inside each key the fingerprints are compared in bit-sliced form: bit planes are stored
vertically, eight fingerprints a byte, the planes' differences are added up by carry-save
counters that overflow beyond the radius, and a block of lanes is abandoned once all have
overflowed.

Only connectivity is wanted, so a key's nodes need not all be compared with each other: what has
been reached from a node leaves the set that later nodes are compared with.  A large group of near
copies so costs about one comparison a member, and at most one link a member leaves the task.

Defined results: null texts count as empty; texts without words have fingerprint zero and link
like any other; repeated rows are kept; an empty table gives no rows; rows with a null id get a
component of their group's other rows, or null; other columns of the input are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import table, written
from .components import connected_components

#: Rows of shingle hashes that are counted at a time, and of keyed fingerprints compared at a time.
HASH_ROWS, KEYED_ROWS = 4096, 60_000
#: Keys with more nodes than this are explored node by node, smaller ones all at once.
SMALL_KEY = 48


def exact_masks(radius: int, shared: int) -> np.ndarray:
    """Masks of 64-bit fingerprints: all ways to choose ``shared`` of ``radius + shared`` blocks.

    If at most ``radius`` blocks hold a difference, at least ``shared`` do not."""
    n = radius + shared
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]
    return np.array([[sum(c)] for c in combinations(blocks, shared)], dtype=np.uint64)


@dataclass(frozen=True)
class Scheme:
    """shingle: words in a shingle; words: 64-bit words in a fingerprint; radius: most bits that linked ones differ in."""

    shingle: int = 3
    words: int = 1
    radius: int = 3
    masks: np.ndarray = field(default_factory=lambda: exact_masks(3, 3))


#: The query's contract: 3 words, 64 bits, 3 bits apart, no link lost.
CONTRACT = Scheme()


def _mixed(h: np.ndarray, step: int) -> np.ndarray:
    """The step-th further word for each hash (a splitmix finaliser)."""
    z = h + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: bytes, scheme: Scheme) -> bytes:
    """The fingerprint of a text in UTF-8 as little-endian words."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white spaces
    k = scheme.shingle
    if not words:
        return bytes(8 * scheme.words)
    n = max(1, len(words) - k + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)))) if len(words) >= k else iter([b" ".join(words)])
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype=np.uint64, count=n)
    counts = np.zeros(64 * scheme.words, dtype=np.int64)
    for at in range(0, n, HASH_ROWS):
        part = h[at : at + HASH_ROWS]
        wide = np.stack([part, *(_mixed(part, j) for j in range(1, scheme.words))], axis=1) if scheme.words > 1 else part[:, None]
        bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
        for b in range(0, len(bits), 255):
            counts += np.add.reduce(bits[b : b + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > n, bitorder="little").tobytes()


def fingerprints(docs: DataFrame, scheme: Scheme, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each whole text, as binary."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            found = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", scheme) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, fp binary")


def _spread(key: np.ndarray) -> np.ndarray:
    """One 64-bit key from the words under a mask and the table's number (first column)."""
    out = np.zeros(len(key), dtype=np.uint64)
    for c in range(key.shape[1]):
        out = _mixed(out ^ key[:, c], c + 1)
    return out


def keyed(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """(key, node, fp): a row for each node and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 4096):
                b = whole.slice(at, 4096)
                fp = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint64).reshape(len(b), scheme.words)
                for i, mask in enumerate(scheme.masks):
                    key = _spread(np.column_stack([np.full(len(b), i, dtype=np.uint64), fp & mask]))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(0), b.column(1)], ["key", "node", "fp"])

    return nodes.select("node", "fp").mapInArrow(run, "key bigint, node bigint, fp binary")


class _Counters:
    """Carry-save counters for the lanes of some bytes, that overflow beyond the radius."""

    def __init__(self, lanes: int, radius: int):
        self.bits = max(1, radius.bit_length())
        start = (1 << self.bits) - 1 - radius
        self.planes = [np.full(lanes, 255 if start >> j & 1 else 0, dtype=np.uint8) for j in range(self.bits)]
        self.over = np.zeros(lanes, dtype=np.uint8)

    def add_two(self, x: np.ndarray, y: np.ndarray) -> None:
        """Add two planes of differences: one full adder, then the carry ripples on."""
        ones = self.planes[0]
        half = ones ^ x
        carry = (ones & x) | (half & y)
        self.planes[0] = half ^ y
        for j in range(1, self.bits):
            carry, self.planes[j] = carry & self.planes[j], self.planes[j] ^ carry
        self.over |= carry

    def keep(self, lanes: np.ndarray) -> None:
        self.planes = [p[lanes] for p in self.planes]
        self.over = self.over[lanes]


def _planes(bits: np.ndarray) -> np.ndarray:
    """[plane, byte] of [row, plane] bits: eight rows a byte."""
    return np.packbits(bits.T, axis=1, bitorder="little")


def within(difference, planes: int, lanes: np.ndarray, active: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the active lanes differ in at most ``radius`` planes: (bytes, masks).

    difference(i, lanes): plane i of the differences in the bytes ``lanes``.  Bytes whose active
    lanes have all overflowed are abandoned every few planes."""
    count = _Counters(len(lanes), radius)
    for i in range(0, planes, 2):
        count.add_two(difference(i, lanes), difference(i + 1, lanes))
        if i % 16 == 14 and i >= radius:
            alive = (active & ~count.over) != 0
            if not alive.any():
                return lanes[:0], active[:0]
            if alive.sum() < 0.7 * len(alive):
                lanes, active = lanes[alive], active[alive]
                count.keep(alive)
    hit = active & ~count.over
    some = hit != 0
    return lanes[some], hit[some]


def _rows_of(lanes: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Row numbers of the set bits."""
    byte, bit = np.nonzero(np.unpackbits(hit[:, None], axis=1, bitorder="little"))
    return lanes[byte] * 8 + bit


def small_links(key: np.ndarray, bits: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows within the radius that have one key; key is sorted and its groups are small.

    Rows are compared with those d further on, for each d, all rows at once."""
    n, planes = bits.shape
    size = -(-n // 8) + SMALL_KEY // 8 + 2
    shifted: dict[int, np.ndarray] = {}

    def shift(r: int) -> np.ndarray:
        if r not in shifted:
            p = _planes(bits[r:])
            shifted[r] = np.pad(p, ((0, 0), (0, size - p.shape[1])))
        return shifted[r]

    a, b = [], []
    base = shift(0)
    for d in range(1, n):
        same = np.packbits(key[:-d] == key[d:], bitorder="little")
        lanes = np.flatnonzero(same)
        if not len(lanes):
            break
        ahead, q = shift(d % 8), d // 8
        i = _rows_of(*within(lambda p, at: base[p][at] ^ ahead[p][at + q], planes, lanes, same[lanes], radius))  # noqa: B023
        a.append(i)
        b.append(i + d)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def large_links(bits: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within the radius that connect all that such pairs connect, at most one a row."""
    n, planes = bits.shape
    rows = np.arange(n)
    left = np.ones(n, dtype=bool)
    held = _planes(bits)
    a, b, frontier = [], [], []
    while True:
        if frontier:
            at = frontier.pop()
        else:
            rest = rows[left]
            if len(rest) < 2:
                break
            at = rest[0]
            left[np.searchsorted(rows, at)] = False
        active = np.packbits(left, bitorder="little")
        lanes = np.flatnonzero(active)
        if not len(lanes):
            if not frontier:
                break
            continue
        flip = np.where(bits[at], 255, 0).astype(np.uint8)
        hit = _rows_of(*within(lambda p, x: held[p][x] ^ flip[p], planes, lanes, active[lanes], radius))  # noqa: B023
        if len(hit):
            found = rows[hit]
            a.append(np.full(len(found), at))
            b.append(found)
            left[hit] = False
            frontier += found.tolist()
            if left.sum() < 0.5 * len(left):  # repack what is left
                rows = rows[left]
                held, left = _planes(bits[rows]), np.ones(len(rows), dtype=bool)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *a]).astype(np.int64), np.concatenate([none, *b]).astype(np.int64)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest row connected to each of n rows."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def links_of_sorted(key: np.ndarray, node: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes that connect what fingerprints within the radius under one key connect."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    out = []

    def collect(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        low = _forest(a, b, len(rows))
        one = np.flatnonzero(low != np.arange(len(rows)))
        out.append((node[rows[one]], node[rows[low[one]]]))

    group = np.repeat(size, size)
    rows = np.flatnonzero((group > 1) & (group <= SMALL_KEY))
    if len(rows):
        collect(rows, *small_links(key[rows], np.unpackbits(fp[rows].view(np.uint8), axis=1, bitorder="little"), radius))
    for s, m in zip(start[size > SMALL_KEY], size[size > SMALL_KEY]):
        rows = np.arange(s, s + m)
        collect(rows, *large_links(np.unpackbits(fp[rows].view(np.uint8), axis=1, bitorder="little"), radius))
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *(x for x, _ in out)]), np.concatenate([none, *(y for _, y in out)])


def near_links(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """(a, b): links between nodes (node, fp), enough to connect all that are within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def done(key, node, fp):
            a, b = links_of_sorted(key, node, fp, scheme.radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        rows = 0
        for batch in batches:
            if not len(batch):
                continue
            fp = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint64).reshape(len(batch), scheme.words)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), fp))
            rows += len(batch)
            if rows < KEYED_ROWS:
                continue
            key, node, fp = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if cut:
                yield done(key[:cut], node[:cut], fp[:cut])
            held, rows = [(key[cut:], node[cut:], fp[cut:])], len(key) - cut
        if rows:
            yield done(*(np.concatenate(x) for x in zip(*held)))

    rows = keyed(nodes, scheme)
    dealt = rows.repartition(F.col("key")).sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, scheme: Scheme = CONTRACT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id that links reach, itself included."""
    prints = written(fingerprints(docs, scheme, id_col, text_col), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("node")), "nodes")
    found = connected_components(near_links(nodes.where("node IS NOT NULL"), scheme))
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.concat(*[F.hex(F.substring("fp", at, 1)) for at in range(8, 0, -1)])
    return found.select("doc_id", F.lower(digits).alias("fingerprint"), "component_id")
