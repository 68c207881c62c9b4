"""Near copies by SimHash: texts whose sets of word shingles have a Jaccard similarity of ``least`` or more.

A text's shingles (``words`` words each; A-Z lower-cased, split at ASCII white space; fewer words: the
whole) count once.  Their 256-bit SimHash is compared in bit-sliced form (see :mod:`.simhash`), and pairs
within RADIUS are confirmed on the shingles themselves, so a link is never a guess of the fingerprint.

Fingerprints that are equal become one node.  Which nodes are compared is decided by keys: each
text has BANDS keys of ROWS minima of its shingles' hashes, so that two texts of similarity 0.8
miss each other in all of them with probability (1 - 0.8^5)^16 = 0.002, and texts that share little hardly ever meet,
however large the corpus.  Keys taken from fingerprint bits would fill up as the corpus grows.

No key is ever held in one task.  In each round some nodes of each key, its leaders, are compared with
all its others, by joins; links that hold merge nodes into components.  A leader that has met all
leaves its key, and a key is closed once all left in it are of one component: no link in it can
join anything more.  The first round has one leader a key, which settles groups of copies; later
rounds first compare what is outside a key's largest component with PROBES nodes of it, and then take leaders from what still
is outside, LEADERS of them, then four times as many in each round; a pair is compared in the first key that it shares, and not again.  So no link is lost among texts that share a key, nor are all pairs of a group listed.

Defined results: null texts count as empty; texts without words form one group; repeated rows are
kept; an empty table gives no rows; other columns are ignored.  Ids must be unique and not null
(number the rows first where they are not: :func:`numbered`)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import filter_of, forget, passes, written
from .components import connected_components
from .simhash import _mixed, _planes, _rows_of, within

WORDS, LEAST = 5, 0.8
#: 64-bit words of a fingerprint; two texts of similarity 0.8 differ in 39 of 256 bits on average (standard deviation 6).
WIDE, RADIUS = 4, 60
BANDS, ROWS = 16, 5
LEADERS, PROBES = 16, 16
HASH_ROWS = 2048
_ODD = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct shingles' XXH64 values, ascending."""
    w = text.lower().split()
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)] if w else [], dtype=np.uint64)
    joined = map(b" ".join, zip(*(w[i:] for i in range(words))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(42)), dtype=np.uint64, count=len(w) - words + 1))


def print_of(h: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(fingerprint, keys) of a set of shingles; no shingles have no keys."""
    if not len(h):
        return bytes(8 * WIDE), np.zeros(0, np.int64)
    counts, least = np.zeros(64 * WIDE, np.int64), np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), HASH_ROWS):
        part = h[at : at + HASH_ROWS]
        least = np.minimum(least, (part[:, None] * _ODD).min(axis=0))
        bits = np.unpackbits(np.stack([part, *(_mixed(part, j) for j in range(1, WIDE))], axis=1).view(np.uint8), axis=1, bitorder="little")
        for b in range(0, len(bits), 255):
            counts += np.add.reduce(bits[b : b + 255], axis=0, dtype=np.uint8)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = _mixed(key ^ row, 1)
    return np.packbits(2 * counts > len(h), bitorder="little").tobytes(), key.view(np.int64)


def _texts(column: pa.Array) -> Iterator[bytes]:
    return (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column.cast(pa.binary()))


def prints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, fp, keys) of each text of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, keys = zip(*(print_of(shingles(t, words)) for t in _texts(b.column(1)))) if len(b) else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "fp", "keys"])

    return docs.select(F.col("id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "id bigint, fp binary, keys array<bigint>")


def shingle_sets(docs: DataFrame, members: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, fp, set) of the texts (id, text) whose ids are among ``members`` (node, fp): set holds the shingles' hashes."""
    held = filter_of(members, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = pa.array(np.flatnonzero(passes(held.value, b.column(0).to_numpy())))
            texts = b.column(1).take(some)
            yield pa.RecordBatch.from_arrays([b.column(0).take(some), pa.array([shingles(t, words).tobytes() for t in _texts(texts)], pa.binary())], ["node", "set"])

    found = docs.select(F.col("id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "node bigint, set binary")
    return found.join(members, "node").select("node", "fp", "set")


def _close(pairs: DataFrame, radius: int) -> DataFrame:
    """The pairs (a, b, fa, fb) whose fingerprints are within the radius, compared bit-sliced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            planes = [_planes(np.unpackbits(np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(len(b), -1), axis=1, bitorder="little")) for c in (2, 3)]
            active = np.packbits(np.ones(len(b), np.uint8), bitorder="little")
            hit = within(lambda i, at: planes[0][i][at] ^ planes[1][i][at], 64 * WIDE, np.arange(len(active)), active, radius)  # noqa: B023
            take = pa.array(np.sort(_rows_of(*hit)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take)], ["a", "b"])

    return pairs.select("a", "b", "fa", "fb").mapInArrow(run, "a bigint, b bigint")


def _alike(pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, sa, sb) whose sets have a similarity of ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                if min(len(x), len(y)) < least * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= least * (len(x) + len(y) - both):
                    keep.append(i)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take)], ["a", "b"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that are linked."""
    pairs = written(pairs, "near-pairs")
    side = lambda c, name: sets.select(F.col("node").alias(c), F.col(name).alias(("f" if name == "fp" else "s") + c))
    close = written(_close(pairs.join(side("a", "fp"), "a").join(side("b", "fp"), "b"), RADIUS), "near-close")
    links = written(_alike(close.join(side("a", "set"), "a").join(side("b", "set"), "b"), least), "near-links")
    forget(pairs)
    forget(close)
    return links


def _open(rows: DataFrame) -> DataFrame:
    """Rows (key, node, comp) of keys that hold more than one component."""
    mixed = written(rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key"), "near-mixed")
    return rows.join(mixed, "key", "left_semi")


def _settled(links: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components (node, comp) of the links, the rows (key, node) with their comp, of keys that are still open)."""
    comps = written(connected_components(links).select("node", F.col("component").alias("comp")), "near-components")
    placed = rows.join(comps, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    return comps, written(_open(written(placed, "near-rest")), "near-open")


def _heads(rows: DataFrame, keys: DataFrame, most: int) -> DataFrame:
    """(key, head, head_comp, head_keys): at most so many of the rows of each key."""
    w = Window.partitionBy("key").orderBy("node")
    chosen = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return written(chosen.join(keys, "node").select("key", F.col("node").alias("head"), F.col("comp").alias("head_comp"), F.col("keys").alias("head_keys")), "near-heads")


def _met(rows: DataFrame, heads: DataFrame, keys: DataFrame) -> DataFrame:
    """(a, b): rows and the heads of their keys, if of different components.

    A pair is met in the first of the keys that it shares: in the others it would be the same again."""
    first = F.get("keys", F.array_position(F.zip_with("keys", "head_keys", lambda x, y: x == y), True) - 1)
    met = rows.select("key", "node", "comp").join(keys, "node").join(heads, "key").where((F.col("comp") != F.col("head_comp")) & (first == F.col("key")))
    return met.select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """(id, component_id): component_id is the smallest id that links reach, itself included."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = written(prints(texts, words), "near-prints")
    nodes = written(found.groupBy("fp").agg(F.min("id").alias("node"), F.min_by("keys", "id").alias("keys")), "near-nodes")
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).where("n > 1").select("key", "leader"), "near-shared")
    rows = written(keyed.join(shared, "key").select("key", "node", "leader"), "near-keys")
    sets = written(shingle_sets(texts, nodes.select("node", "fp").join(rows.select("node").distinct(), "node", "left_semi"), words), "near-sets")
    rest = rows.where("node <> leader")
    links = _confirmed(rest.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), sets, least)
    leaders, keys = LEADERS, nodes.select("node", "keys")
    comps, rest = _settled(links, rest.select("key", "node"))
    while not rest.isEmpty():
        largest = rest.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("base"))
        based = written(rest.join(written(largest, "near-largest"), "key"), "near-based")
        # Most of what is outside the largest component is joined to it by one of a few of its nodes.
        probes = _heads(based.where("comp = base"), keys, PROBES)
        links = links.unionByName(_confirmed(_met(based.where("comp <> base"), probes, keys), sets, least))
        comps, rest = _settled(links, rest.select("key", "node"))
        if rest.isEmpty():
            break
        # What is still outside is compared with all: a leader that has met all leaves its key.
        outside = rest.join(based.select("key", "base").distinct().join(comps.select(F.col("node").alias("base"), F.col("comp").alias("now")), "base", "left").select("key", F.coalesce("now", "base").alias("base")), "key").where("comp <> base")
        chosen = _heads(outside, keys, leaders)
        links = links.unionByName(_confirmed(_met(rest, chosen, keys), sets, least))
        rest = rest.select("key", "node").join(chosen.select("key", F.col("head").alias("node")), ["key", "node"], "left_anti")
        comps, rest = _settled(links, rest)
        leaders *= 4
    named = nodes.select("fp", "node").join(comps, "node", "left").select("fp", F.coalesce("comp", "node").alias("component_id"))
    return found.select("id", "fp").join(named, "fp").select(F.col("id").alias(id_col), "component_id")


def numbered(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """(docs, name of a column of unique ids): ``docs`` itself, or with numbered rows if ids repeat or are null."""
    odd = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(id_col).isNull())
    if odd.isEmpty():
        return docs, id_col
    name = "_row"
    while name in docs.columns:
        name += "_"
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name
