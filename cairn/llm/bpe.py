"""Byte-level BPE: encoding and decoding by padded numpy matrices.

A text is cut into the matches of the pattern, each encoded by itself.  The distinct pieces of a
batch of texts are encoded once.  Pieces are put into matrices by length: a row a piece, a column
a byte, padded on the right.  In each round every row that still can merges its leftmost pair of
minimum rank, the rank of each pair of neighbouring tokens being looked up in an open-addressing
hash table of numpy arrays; then the row is compacted.  Rows without a pair to merge leave the
matrix.  A piece of more than LONG bytes is a row by itself, whose rounds merge all pairs that single
merges would take next.  Memory stays bounded by ``CELLS`` and the longest piece.

Defined results: null texts count as empty and have no tokens; invalid surrogates cannot occur in
Spark strings; repeated rows are kept; an empty table gives no rows; other columns of the input
are ignored."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import table

#: Cells of a matrix, characters of text and distinct pieces handled at a time.
CELLS, BATCH_CHARS, PIECES = 1 << 20, 1 << 21, 1 << 17
#: Pieces of more bytes than this are rows of their own.
LONG = 512
#: Pieces remembered between batches, and their characters.
REMEMBERED, REMEMBERED_CHARS = 1 << 18, 1 << 25
PUBLIC = "public:"
NONE = np.int64(1 << 40)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token, of a file, or (``public:`` and a name) of one that the tokenizers' package has on this machine."""
    if path.startswith(PUBLIC):
        import public_tokenizers

        path = public_tokenizers.path(path.removeprefix(PUBLIC))
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """Encodes by the ranks in a file of ``base64-token rank`` lines and a pattern of pieces."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self._pairs()
        self.size = max(self.tokens) + 1
        self._forget()
        lengths = np.zeros(self.size, dtype=np.int64)
        for rank, token in self.tokens.items():
            lengths[rank] = len(token)
        self.starts = np.r_[0, np.cumsum(lengths)]
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(self.size)), dtype=np.uint8)

    def _pairs(self) -> None:
        """The hash table: for each token, every split into two tokens leads to its rank."""
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        key = np.array(left, dtype=np.int64) << 32 | np.array(right, dtype=np.int64)
        bits = max(4, int(2 * len(key)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, dtype=np.int64)
        self.merged = np.full(1 << bits, NONE, dtype=np.int64)
        todo, probe = np.arange(len(key)), 0
        while len(todo):  # linear probing, all keys at once: the first at each free slot gets it
            at = (self._slot(key[todo]) + probe) & (len(self.slots) - 1)
            free = self.slots[at] == -1
            first = np.zeros(len(todo), dtype=bool)
            first[np.unique(np.where(free, at, -1), return_index=True)[1]] = True
            put = free & first
            self.slots[at[put]], self.merged[at[put]] = key[todo[put]], np.array(rank, dtype=np.int64)[todo[put]]
            # One that lost its slot to another tries it again at the next probe, as lookups do.
            todo, probe = todo[~put], probe + 1
        self.probes = probe

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank that each pair merges to; NONE if it does not."""
        key = (left << 32 | right).ravel()
        out = np.full(key.shape, NONE, dtype=np.int64)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        want = key[todo]
        slot = self._slot(want)
        for probe in range(self.probes):
            if not len(todo):
                break
            at = (slot + probe) & (len(self.slots) - 1)
            found = self.slots[at]
            hit = found == want
            out[todo[hit]] = self.merged[at[hit]]
            on = ~hit & (found != -1)
            todo, want, slot = todo[on], want[on], slot[on]
        return out.reshape(left.shape)

    def encode_matrix(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the rows of a matrix of ranks, padded with -1, as far as they go: (matrix, lengths)."""
        done = np.full(rows.shape, -1, dtype=np.int64)
        live = np.arange(len(rows))
        rank = self.lookup(rows[:, :-1], rows[:, 1:]) if rows.shape[1] > 1 else np.zeros((len(rows), 0), dtype=np.int64)
        while len(live) and rank.shape[1]:
            at = rank.argmin(axis=1)  # the leftmost of the smallest
            here = np.arange(len(live))
            best = rank[here, at]
            stop = best == NONE
            if stop.any():
                done[live[stop], : rows.shape[1]] = rows[stop]
                go = ~stop
                live, rows, rank, at, best = live[go], rows[go], rank[go], at[go], best[go]
                if not len(live):
                    break
                here = np.arange(len(live))
            rows[here, at] = best
            cols = np.arange(rows.shape[1] - 1)
            take = cols + (cols > at[:, None])  # compaction: drop the right one of the pair
            rows = np.take_along_axis(rows, take, axis=1)
            cols = cols[:-1]
            rank = np.take_along_axis(rank, np.minimum(cols + (cols >= at[:, None]), rank.shape[1] - 1), axis=1)
            if not rank.shape[1]:
                break
            for side in (at - 1, at):  # only the two pairs around the merged token are new
                ok = (side >= 0) & (side < rank.shape[1])
                r, c = here[ok], side[ok]
                rank[r, c] = self.lookup(rows[r, c], rows[r, c + 1])
            width = int((rows >= 0).sum(axis=1).max())
            rows, rank = rows[:, :width], rank[:, : max(width - 1, 0)]
        if len(live):
            done[live, : rows.shape[1]] = rows
        return done, (done >= 0).sum(axis=1)

    def encode_long(self, ids: np.ndarray) -> np.ndarray:
        """Merge one long row.  A round takes the leftmost pair of minimum rank and goes on to the right with
        the pairs of that rank for as long as no merge makes a pair of smaller rank: what single
        merges would do one by one."""
        rank = self.lookup(ids[:-1], ids[1:])
        while len(rank):
            best = rank.min()
            if best == NONE:
                break
            at = np.flatnonzero(rank == best)
            run = at - np.arange(len(at))
            first = np.r_[True, run[1:] != run[:-1]]
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[nth % 2 == 0]  # of overlapping pairs every other
            left = np.where(at > 0, ids[at - 1], -1)
            after = np.r_[False, at[1:] == at[:-1] + 2]
            left[after] = best
            right = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            made = np.full(len(at), best)
            lower = np.flatnonzero(np.minimum(self.lookup(left, made), self.lookup(made, right)) < best)
            if len(lower):
                at = at[: lower[0] + 1]
            ids = ids.copy()
            ids[at] = best
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            places = np.cumsum(keep)[at] - 1
            ids = ids[keep]
            gone = np.ones(len(rank), dtype=bool)
            gone[at] = False
            rank = rank[gone]  # one pair less for each merge; those beside it are looked up again
            for side in (places - 1, places):
                side = side[(side >= 0) & (side < len(rank))]
                rank[side] = self.lookup(ids[side], ids[side + 1])
        return ids

    def encode_pieces(self, pieces: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(order, ids, sizes): the ids of all pieces one after another in that order of the pieces."""
        whole = [self.ranks.get(p, -1) for p in pieces]
        order = [i for i, r in enumerate(whole) if r >= 0]
        flat, sizes = [np.array([whole[i] for i in order], dtype=np.uint32)], [np.ones(len(order), dtype=np.int64)]
        rest = sorted((i for i, r in enumerate(whole) if r < 0), key=lambda i: len(pieces[i]))
        while rest and len(pieces[rest[-1]]) > LONG:
            i = rest.pop()
            ids = self.encode_long(self.byte_rank[np.frombuffer(pieces[i], dtype=np.uint8)])
            order.append(i)
            flat.append(ids.astype(np.uint32))
            sizes.append(np.array([len(ids)]))
        at = 0
        while at < len(rest):
            # Lengths in a matrix differ by a quarter at most.
            most = len(pieces[rest[at]]) * 5 // 4
            end = at + 1
            while end < len(rest) and len(pieces[rest[end]]) <= most and (end - at + 1) * len(pieces[rest[end]]) <= CELLS:
                end += 1
            some = rest[at:end]
            size = np.array([len(pieces[i]) for i in some])
            width = int(size[-1])
            rows = np.full((len(some), width), -1, dtype=np.int64)
            rows[np.arange(width) < size[:, None]] = self.byte_rank[np.frombuffer(b"".join(pieces[i] for i in some), dtype=np.uint8)]
            ids, n = self.encode_matrix(rows)
            flat.append(ids[ids >= 0].astype(np.uint32))
            sizes.append(n)
            order += some
            at = end
        return order, np.concatenate(flat), np.concatenate(sizes)

    def _learn(self, pieces: list[str]) -> None:
        """Encode these pieces and remember where their ids stand."""
        for at in range(0, len(pieces), PIECES):
            some = pieces[at : at + PIECES]
            order, flat, sizes = self.encode_pieces([p.encode() for p in some])
            self.known.update(zip((some[i] for i in order), range(len(self.size_of), len(self.size_of) + len(order))))
            self.start_of = np.concatenate([self.start_of, len(self.flat) + np.cumsum(sizes) - sizes])
            self.size_of = np.concatenate([self.size_of, sizes])
            self.flat = np.concatenate([self.flat, flat])

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.start_of, self.size_of, self.flat = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text.  Texts that share pieces share their encoding."""
        cut = [self.pattern.findall(t) for t in texts]
        wanted = set().union(*cut)
        new = wanted.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED or self.chars + sum(map(len, new)) > REMEMBERED_CHARS:
            self._forget()
            new = wanted
        self.chars += sum(map(len, new))
        self._learn(sorted(new))
        counts = np.array([len(c) for c in cut], dtype=np.int64)
        piece = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=int(counts.sum()))
        size = self.size_of[piece]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.start_of[piece] - (end - size), size)]
        ends = np.r_[0, end][np.cumsum(counts)]
        return [ids[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, gathered at once from all tokens' bytes."""
        if not len(ids):
            return b""
        start = self.starts[ids]
        size = self.starts[ids.astype(np.int64) + 1] - start
        end = np.cumsum(size)
        at = np.arange(end[-1]) + np.repeat(start - (end - size), size)
        return self.bytes[at].tobytes()


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each file and pattern in a process."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def _grouped(texts: list[str]) -> Iterator[list[str]]:
    some, n = [], 0
    for t in texts:
        some.append(t)
        n += len(t)
        if n > BATCH_CHARS:
            yield some
            some, n = [], 0
    if some:
        yield some


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", carried: list[str] | None = None) -> DataFrame:
    """(id, carried columns, ids, decoded): the token ids of each whole text as little-endian unsigned 32-bit
    integers, and the bytes that they decode to."""
    carried = carried or []
    columns = [id_col, *carried]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for b in batches:
            at = 0
            for some in _grouped([t or "" for t in b.column(len(columns)).to_pylist()]):
                ids = own.encode_texts(some)
                back = [own.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i).slice(at, len(some)) for i in range(len(columns))), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array(back, pa.binary())], [*columns, "ids", "decoded"]
                )
                at += len(some)

    return docs.select(*columns, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"{kinds}, ids binary, decoded binary")


def digests(encoded: DataFrame, id_col: str = "doc_id", more: list[str] | None = None) -> DataFrame:
    return encoded.select(
        id_col,
        *(more or []),
        F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return PUBLIC + "byte_bpe_50k.tiktoken", public_tokenizers.PATTERN  # each worker finds the file where it is


def query(spark, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents"), *default_files()))
