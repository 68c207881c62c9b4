"""Language-model scoring: a bigram model in Elias-Fano tries, one for each shard of words.

Tokens are the A-Z lower-cased runs of what is not ASCII white space, then one end a text.  The
model is P(w | v) = (1 - m) P1(w) + m c(v, w) / c(v), with P1(w) = (c(w) + 1) / (N + V + 1) and the
share m of the predecessor's own counts growing with their number (:func:`share`; 0 for an unknown one).

A first pass counts all words of the texts that may be learnt from, combined in each task before
the shuffle.  A second finds which predecessors each shard will see, and how often the frequent words follow each other; it meets
the predecessors with their counts by ranges of the predecessor's 32 bits, and sends every shard the counts of its own.
A last pass sends every token, with its predecessor, to the shard of its word:
texts to learn from and texts to score travel together, packed by word, about six bytes a token.
A shard counts its bigrams and builds its trie.  Level 1 holds the words' hashes, level 2 for each
word its predecessors; monotone pointers lead from one to the other.  All three sequences are
Elias-Fano coded: low bits packed, high bits in unary.  A predecessor is stored relative to its word:
its hash scaled to the number of the word's predecessors, so that values are spread evenly and a
successor search from the high bits reads one or two entries.  Probabilities are kept in 8 bits (of
bigrams) and 16 bits (of words).  All levels lie in one memory map, and the token's probability is
found by successor search in it.  What leaves a shard is a sum for each text that has tokens there (at most one a token), packed.

:func:`fit` keeps the tries instead: a table with a row a shard in the shared folder, since workers share no local
files.  :func:`score` scores any other table by them: its tokens travel to the shards, each of which maps its row into memory.

Nothing is broadcast that grows with the corpus but the words so frequent that they would fill a shard
(at most 4 times the number of shards), which are spread over several by predecessor, and the pairs so
frequent (as many at most), which are spread by text; both with their counts.
The counts of predecessors are exact and shuffled like the tokens.  Words are told apart by 64-bit
hashes, predecessors by 32 bits: those of one value (V / 2^32 of V words) count as one everywhere.
Level 2 keeps 24 of these bits beside the word's own place, or all 32 where two of a word's would meet: a pair that was
not seen is taken for one that was with a probability of 2^-24 at most for each predecessor of the word.

Defined results: null texts count as empty, whose only token is the end; an empty table gives no
rows; if nothing may be learnt, N = V = 0 and every token has P1 = 1; repeated rows are kept;
rows whose id and text have the same 64-bit hash share a score; a null id is not held out; other columns are ignored."""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import id_bucket, table, written

#: The share of a predecessor's own counts: of one that occurs once, more for each doubling, and at most.
SHARE, DOUBLING, MOST = 0.28, 0.025, 0.8
#: Tokens of a shard; bytes of text packed at a time; predecessors of shards that a task holds before it sends them.
SHARD_TOKENS, PART_BYTES, HELD_PAIRS = 2_500_000, 1 << 22, 2_000_000
#: Texts whose sums are added up at a time.
BUCKET_ROWS = 20_000
SPREAD_BITS = 24
#: Words contain no blank, so these are nobody's hash but by chance.
END, START = np.uint64(xxhash.xxh64_intdigest(b" end ")), np.uint64(xxhash.xxh64_intdigest(b" start "))


def share(count: np.ndarray) -> np.ndarray:
    """How much of P(w | v) comes from c(v, w) / c(v), by c(v)."""
    return np.where(count > 0, np.minimum(MOST, SHARE + DOUBLING * np.log2(np.maximum(count, 1))), 0.0)


@dataclass(frozen=True)
class Hot:
    """Frequent words (ascending hashes) with their counts and over how many shards they are spread, and frequent pairs with theirs."""

    word: np.ndarray
    count: np.ndarray
    spread: np.ndarray
    pair: np.ndarray
    pair_count: np.ndarray


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token, tokens of each text)."""
    words = [t.lower().split() for t in texts]
    size = np.array([len(w) + 1 for w in words], dtype=np.int64)
    out = np.full(int(size.sum()), END, dtype=np.uint64)
    real = np.ones(len(out), dtype=bool)
    real[np.cumsum(size) - 1] = False
    out[real] = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), dtype=np.uint64, count=int(real.sum()))
    return out, size


def _parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    some, n = [], 0
    for t in texts:
        some.append(t)
        n += len(t)
        if n > PART_BYTES:
            yield some
            some, n = [], 0
    if some:
        yield some


def _bytes_of(column: pa.Array) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column.cast(pa.binary())]


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): how often each token's hash occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

        for b in batches:
            for some in _parts(_bytes_of(b.column(0))):
                new, m = np.unique(tokens_of(some)[0], return_counts=True)
                word, at = np.unique(np.concatenate([word, new]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n, m])).astype(np.int64)
                if len(word) > 1_500_000:
                    yield out()
                    word, n = word[:0], n[:0]
        if len(word):
            yield out()

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary with zeros counted by word."""

    @staticmethod
    def parts(values: np.ndarray, universe: int) -> tuple[int, list[np.ndarray]]:
        """(low bits, arrays) of ``values``, which are below ``universe``."""
        n = len(values)
        low = max(0, min(56, (universe // max(n, 1)).bit_length() - 1))
        packed = []
        for at in range(0, n, 1 << 16):  # a multiple of eight values ends on a byte
            v = values[at : at + (1 << 16)]
            packed.append(np.packbits(((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little"))
        lows = np.concatenate([*packed, np.zeros(8, np.uint8)])
        high = (values >> np.uint64(low)).astype(np.int64)
        size = n + (int(universe) >> low) + 2
        bits = np.zeros(-(-size // 64) * 64, dtype=np.uint8)
        bits[high + np.arange(n)] = 1
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        zeros = np.cumsum(64 - np.bitwise_count(words).astype(np.int64))
        return low, [lows, words.view(np.uint8), np.r_[0, zeros].astype(np.uint32).view(np.uint8)]

    def __init__(self, n: int, low: int, arrays: list[np.ndarray]):
        self.n, self.low = n, low
        lows, words, zeros = arrays
        self.lows = np.ndarray((len(lows) - 7,), dtype="<u8", buffer=lows, strides=(1,))
        self.words, self.zeros = words.view(np.uint64), zeros.view(np.uint32)
        self.mask = np.uint64((1 << low) - 1)

    def low_of(self, i: np.ndarray) -> np.ndarray:
        p = i * self.low
        return (self.lows[p >> 3] >> (p & 7).astype(np.uint64)) & self.mask

    def below(self, high: np.ndarray) -> np.ndarray:
        """How many values have smaller high bits: ones before the zero that ends the class before."""
        nth = high - 1  # this zero
        at = np.searchsorted(self.zeros, np.maximum(nth, 0), side="right") - 1
        left = np.maximum(nth, 0) - self.zeros[at]
        x, base = ~self.words[at], np.zeros(len(high), dtype=np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            here = np.bitwise_count(x & np.uint64((1 << width) - 1)).astype(np.int64)
            up = left >= here
            left = left - np.where(up, here, 0)
            base += np.where(up, width, 0)
            x = np.where(up, x >> np.uint64(width), x)
        return np.where(high > 0, at * 64 + base - nth, 0)

    def successor(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first entry that is not smaller, whether it is equal)."""
        high, low = (value >> np.uint64(self.low)).astype(np.int64), value & self.mask
        at, end = self.below(high), self.below(high + 1)
        going = np.flatnonzero(at < end)
        equal = np.zeros(len(value), dtype=bool)
        while len(going):
            got = self.low_of(at[going])
            equal[going] = got == low[going]
            less = going[got < low[going]]
            at[less] += 1
            going = less[at[less] < end[less]]
        return at, equal

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at these places, which a successor search has found: needs select on the ones."""
        ones = np.arange(len(self.zeros)) * 64 - self.zeros.astype(np.int64)
        at = np.searchsorted(ones, i, side="right") - 1
        left = i - ones[at]
        x, base = self.words[at], np.zeros(len(i), dtype=np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            here = np.bitwise_count(x & np.uint64((1 << width) - 1)).astype(np.int64)
            up = left >= here
            left = left - np.where(up, here, 0)
            base += np.where(up, width, 0)
            x = np.where(up, x >> np.uint64(width), x)
        return ((at * 64 + base - i).astype(np.uint64) << np.uint64(self.low)) | self.low_of(i)


def _quantised(x: np.ndarray, levels: int) -> tuple[np.ndarray, float, float]:
    lo = float(x.min()) if len(x) else 0.0
    step = (float(x.max()) - lo) / (levels - 1) if len(x) else 0.0
    return np.rint((x - lo) / (step or 1.0)), lo, step


class Trie:
    """word -> predecessors, with quantised log10 probabilities; one memory map holds all levels."""

    HEAD = struct.Struct("<15q4d")

    def __init__(self, data: bytes | memoryview):
        """data: of :meth:`build`."""
        self.map = mmap.mmap(-1, max(8, len(data)))
        self.map[: len(data)] = data
        n, m, self.spread, l1, l2, l3, *sizes, self.w_lo, self.w_step, self.b_lo, self.b_step = self.HEAD.unpack_from(self.map)
        at, held = self.HEAD.size, []
        for size in [*sizes, 2 * n, m]:
            held.append(np.frombuffer(self.map, dtype=np.uint8, count=size, offset=at))
            at += -(-size // 8) * 8
        part = lambda k: [held[k], held[k + 1], held[k + 2]]
        self.level1, self.pointers, self.level2 = EliasFano(n, l1, part(0)), EliasFano(n + 1, l2, part(3)), EliasFano(m, l3, part(6))
        self.word_code, self.bigram_code = held[9].view("<u2"), held[10]

    @classmethod
    def build(cls, words: np.ndarray, log_p: np.ndarray, owner: np.ndarray, context: np.ndarray, log_bigram: np.ndarray) -> bytes:
        """words: ascending hashes; owner, context (32 bits): of each bigram, ascending."""
        n, m = len(words), len(owner)
        pointer = np.r_[np.uint64(0), np.cumsum(np.bincount(owner, minlength=n).astype(np.uint64))]
        for spread in (SPREAD_BITS, 32):
            relative = cls._relative(pointer[owner], pointer[owner + 1] - pointer[owner], context, spread)
            if m < 2 or (relative[1:] > relative[:-1]).all():
                break
        code, w_lo, w_step = _quantised(log_p, 1 << 16)
        code2, b_lo, b_step = _quantised(log_bigram, 1 << 8)
        l1, a1 = EliasFano.parts(words >> np.uint64(8), 1 << 56)
        l2, a2 = EliasFano.parts(pointer, m + 1)
        l3, a3 = EliasFano.parts(relative, (m << spread) + 1)
        levels = [*a1, *a2, *a3]
        head = cls.HEAD.pack(n, m, spread, l1, l2, l3, *map(len, levels), w_lo, w_step, b_lo, b_step)
        parts = [x.tobytes() for x in (*levels, code.astype("<u2"), code2.astype(np.uint8))]
        return head + b"".join(x.ljust(-(-len(x) // 8) * 8, b"\0") for x in parts)

    @staticmethod
    def _relative(first: np.ndarray, size: np.ndarray, context: np.ndarray, spread: int) -> np.ndarray:
        """A predecessor's 32 bits scaled to its word's share of the level."""
        return (first << np.uint64(spread)) + ((context.astype(np.uint64) * size) >> np.uint64(32 - spread))

    def log10(self, word: np.ndarray, context: np.ndarray, own: np.ndarray, unknown: float) -> np.ndarray:
        """log10 P(word | context) of each pair; own: the share of the predecessor's counts; ``unknown``: log10 P1 of a word that was not seen.

        A run of pairs with one word finds the word once."""
        new = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        times = np.diff(np.r_[new, len(word)])
        at, known = self.level1.successor(word[new] >> np.uint64(8))
        at = at[known]
        alone = np.full(len(new), unknown)
        alone[known] = self.word_code[at] * self.w_step + self.w_lo
        out = np.repeat(alone, times) + np.log10(1 - own)
        first, size = np.zeros((2, len(new)), dtype=np.uint64)
        first[known] = self.pointers.get(at)
        size[known] = self.pointers.get(at + 1) - first[known]
        some = np.flatnonzero(np.repeat(size > 0, times))
        first, size = np.repeat(first, times)[some], np.repeat(size, times)[some]
        place, seen = self.level2.successor(self._relative(first, size, context[some], self.spread))
        out[some[seen]] = self.bigram_code[place[seen]] * self.b_step + self.b_lo
        return out

    def word_log10(self, word: np.ndarray, unknown: float) -> tuple[np.ndarray, np.ndarray]:
        """(log10 P1 as kept, whether the word was seen)."""
        at, known = self.level1.successor(word >> np.uint64(8))
        out = np.full(len(word), unknown)
        out[known] = self.word_code[at[known]] * self.w_step + self.w_lo
        return out, known


def _context(h: np.ndarray) -> np.ndarray:
    """The 32 bits that stand for a predecessor."""
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def _pair(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    """64 bits that stand for a pair."""
    return word * np.uint64(0xD6E8FEB86659FD93) + context.astype(np.uint64)


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each key."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _shards(word: np.ndarray, context: np.ndarray, shards: int, hot: Hot, text: np.ndarray | None = None) -> np.ndarray:
    """Words by the range of their hash; frequent ones over several shards by predecessor, frequent pairs by text."""
    out = ((word >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    at, is_hot = _found(hot.word, word)
    if is_hot.any():
        part = context[is_hot].astype(np.uint64) % hot.spread[at[is_hot]].astype(np.uint64)
        if text is not None and len(hot.pair):
            _, often = _found(hot.pair, _pair(word[is_hot], context[is_hot]))
            part[often] = text[is_hot][often] % np.uint64(shards)
        out[is_hot] = (out[is_hot] + part) % np.uint64(shards)
    return out.astype(np.int64)


ROUTED = "shard int, doc binary, learn binary, word binary, run binary, context binary, owner binary"


def route(docs: DataFrame, shards: int, hot: Hot) -> DataFrame:
    """Tokens of (key, learn, text) packed by shard: ids of the texts, whether they teach, the
    distinct words, tokens of each, predecessors and the text's place among the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, learn, at = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), 0
            for some in _parts(_bytes_of(b.column(2))):
                for sub in range(0, len(some), 1 << 16):
                    texts = some[sub : sub + (1 << 16)]
                    rows = slice(at + sub, at + sub + len(texts))
                    word, size = tokens_of(texts)
                    before = np.r_[START, word[:-1]]
                    before[np.cumsum(size) - size] = START
                    context = _context(before)
                    owner = np.repeat(np.arange(len(texts)), size).astype("<u2")
                    shard = _shards(word, context, shards, hot, keys[rows].view(np.uint64)[owner])
                    order = np.lexsort((word, shard)) if len(hot.word) else np.argsort(word, kind="stable")
                    word, context, owner, shard = word[order], context[order], owner[order], shard[order]
                    ids = np.diff(keys[rows], prepend=0).astype("<i8").tobytes()
                    flags = np.packbits(learn[rows]).tobytes()
                    new = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (shard[1:] != shard[:-1])])
                    run_of = np.diff(np.r_[new, len(word)]).astype("<u4")
                    cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
                    ends = np.r_[cuts[1:], len(shard)]
                    d0, d1 = np.searchsorted(new, cuts), np.searchsorted(new, ends)
                    out = [[], [], [], [], [], [], []]
                    for a, e, x, y in zip(cuts.tolist(), ends.tolist(), d0.tolist(), d1.tolist()):
                        for col, v in zip(out, (int(shard[a]), ids, flags, word[new[x:y]].tobytes(), run_of[x:y].tobytes(), context[a:e].tobytes(), owner[a:e].tobytes())):
                            col.append(v)
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], [x.split()[0] for x in ROUTED.split(", ")])
                at += len(some)

    return docs.mapInArrow(run, ROUTED)


def _context_counts(rows: list[dict], hot: Hot) -> tuple[np.ndarray, np.ndarray]:
    """(predecessors, how often each occurs) that a shard was sent, and the frequent words'."""
    frequent = np.where(hot.word == END, START, hot.word)  # an end follows each text, and each text has a start
    before = np.concatenate([_context(frequent), *(np.frombuffer(r["context"], "<u4") for r in rows)])
    times = np.concatenate([hot.count, *(np.frombuffer(r["owner"], "<i8") for r in rows)])
    order = np.lexsort((-times, before))
    before, times = before[order], times[order]
    first = np.flatnonzero(np.r_[True, before[1:] != before[:-1]]) if len(before) else order
    return before[first], times[first]


def _counts_at(before: np.ndarray, times: np.ndarray, context: np.ndarray) -> np.ndarray:
    at, there = _found(before, context)
    return np.where(there, times[at], 0) if len(times) else np.zeros(len(context), np.int64)


def _tokens_in(rows: list[dict]) -> tuple[np.ndarray, ...]:
    """(key of each text, whether it teaches, distinct words, word, predecessor and text of each token)."""
    cols = lambda name, kind: [np.frombuffer(r[name], dtype=kind) for r in rows]
    docs = [np.cumsum(d) for d in cols("doc", "<i8")]
    learn = np.concatenate([np.unpackbits(f, count=len(d)).astype(bool) for f, d in zip(cols("learn", np.uint8), docs)])
    offset = np.cumsum([0, *(len(d) for d in docs[:-1])])
    owner = np.concatenate([o.astype(np.int32) + at for o, at in zip(cols("owner", "<u2"), offset.astype(np.int32))])
    words, at = np.unique(np.concatenate(cols("word", "<u8")), return_inverse=True)
    which = np.repeat(at.astype(np.int32), np.concatenate(cols("run", "<u4")))
    return np.concatenate(docs), learn, words, which, np.concatenate(cols("context", "<u4")), owner


def trie_of(tokens: tuple[np.ndarray, ...], before: np.ndarray, times: np.ndarray, n: int, v: int, hot: Hot) -> tuple[bytes, np.ndarray]:
    """(a shard's trie, count of each of its distinct words)."""
    _, learn, words, which, context, owner = tokens
    teaches = learn[owner]
    count = np.bincount(which[teaches], minlength=len(words))
    place, often = _found(hot.word, words)  # theirs are spread over shards
    count[often] = hot.count[place[often]]
    log_p = np.log10(count + 1.0) - np.log10(n + v + 1)
    known = np.flatnonzero(count > 0)
    rank = np.cumsum(count > 0) - 1
    pair = (rank[which[teaches]].astype(np.uint64) << np.uint64(32)) | context[teaches]
    some = np.flatnonzero(often[which])
    shared = some[_found(hot.pair, _pair(words[which[some]], context[some]))[1]]  # frequent pairs, whoever has them here
    pair = np.concatenate([pair, np.unique((rank[which[shared]].astype(np.uint64) << np.uint64(32)) | context[shared])])
    pair.sort()
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, dtype=np.int64)
    together = np.diff(np.r_[first, len(pair)])
    pair = pair[first]
    who, ctx = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    place, same = _found(hot.pair, _pair(words[known[who]], ctx))
    together[same] = hot.pair_count[place[same]]
    of_context = _counts_at(before, times, ctx)
    own = share(of_context)
    p = (1 - own) * 10 ** log_p[known[who]] + own * together / np.maximum(of_context, 1)
    return Trie.build(words[known], log_p[known], who, ctx, np.log10(p)), count


def score_shard(rows: list[dict], n: int, v: int, hot: Hot) -> tuple[np.ndarray, ...]:
    """(key, tokens, known tokens, base, score) of each text with tokens in this shard.

    Rows without texts hold predecessors and their counts, or (rows with a word) the trie of a model that is at hand."""
    texts = [r for r in rows if r["doc"] is not None]
    model = [r["word"] for r in rows if r["doc"] is None and r["word"] is not None]
    before, times = _context_counts([r for r in rows if r["doc"] is None and r["word"] is None], hot)
    tokens = _tokens_in(texts)
    keys, _, words, which, context, owner = tokens
    log_total = np.log10(n + v + 1)
    if model:
        trie = Trie(model[0])
        log_p, known = trie.word_log10(words, -log_total)
    elif any(r["learn"] and np.frombuffer(r["learn"], np.uint8).any() for r in texts) or len(hot.word):
        data, count = trie_of(tokens, before, times, n, v, hot)
        trie, known = Trie(data), count > 0
        log_p = np.log10(count + 1.0) - log_total
        del data
    else:
        trie, known, log_p = None, np.zeros(len(words), bool), np.full(len(words), -log_total)
    size = len(keys)
    counted, seen = np.bincount(owner, minlength=size), np.bincount(owner, known[which], size)
    base = np.bincount(owner, log_p[which], size)
    pair = (which.astype(np.uint64) << np.uint64(32)) | context
    order = np.argsort(pair)
    owner, pair = owner[order], pair[order]
    del order
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, dtype=np.int64)
    together = np.diff(np.r_[first, len(pair)])
    pair = pair[first]
    got = np.empty(len(pair))
    for a in range(0, len(pair), 1 << 19):  # a pair is looked up once, however often it occurs
        part = slice(a, a + (1 << 19))
        word, before_it = words[(pair[part] >> np.uint64(32)).astype(np.int64)], (pair[part] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        own = share(_counts_at(before, times, before_it))
        got[part] = trie.log10(word, before_it, own, -log_total) if trie else np.log10(1 - own) - log_total
    score = np.bincount(owner, np.repeat(got, together), size)
    some = counted > 0
    return tuple(x[some] for x in (keys, counted, seen.astype(np.int64), base, score))


PAIRS = "bucket int, context binary, value binary, counts boolean"


def _by_bucket(context: np.ndarray, value: np.ndarray, buckets: int, counts: bool) -> pa.RecordBatch:
    """Sorted predecessors with their values, packed by range."""
    bucket = (context.astype(np.uint64) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    ends = np.r_[cuts[1:], len(bucket)].astype(np.int64)
    packed = [pa.array([c[i:j].tobytes() for i, j in zip(cuts, ends)], pa.binary()) for c in (context, value)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts] if len(bucket) else [], pa.int32()), *packed, pa.array([counts] * len(cuts), pa.bool_())], [x.split()[0] for x in PAIRS.split(", ")])


def _sums(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    return key[first], np.add.reduceat(n, first) if len(key) else n


def count_contexts(words: DataFrame, buckets: int) -> DataFrame:
    """The counts of (word, n) by predecessor, packed by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            context, n = _sums(*(np.concatenate(x) for x in zip(*held)))
            return _by_bucket(context.astype("<u4"), n.astype("<i8"), buckets, True)

        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            h = np.where(h == END, START, h)  # an end follows each text, and each text has a start
            held.append((_context(h), b.column(1).to_numpy()))
            if sum(len(c) for c, _ in held) > HELD_PAIRS:
                yield out()
                held = []
        if held:
            yield out()

    return words.select("word", "n").mapInArrow(run, PAIRS)


def seen_contexts(docs: DataFrame, shards: int, hot: Hot, buckets: int) -> DataFrame:
    """Which shards need the count of a predecessor, of the texts (learn, text), packed by range.

    Rows of bucket -1 hold pairs of frequent words with their counts in the texts to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        names = [x.split()[0] for x in PAIRS.split(", ")]
        frequent = np.sort(np.r_[hot.word, START])

        def out(all_of: np.ndarray) -> pa.RecordBatch:
            return _by_bucket((all_of >> np.uint64(32)).astype("<u4"), (all_of & np.uint64(0xFFFFFFFF)).astype("<u4"), buckets, False)

        def often(pair: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([pair.tobytes()], pa.binary()), pa.array([times.tobytes()], pa.binary()), pa.array([True])], names)

        def merged(last: bool) -> Iterator[pa.RecordBatch]:
            """Bring together what has been gathered; send it if it is much, or all there is."""
            nonlocal held, pairs
            if held and (last or sum(map(len, held)) > 2 * HELD_PAIRS):
                held = [np.unique(np.concatenate(held))]
                if last or len(held[0]) > HELD_PAIRS:
                    yield out(held[0])
                    held = []
            if pairs and (last or sum(len(p) for p, _ in pairs) > 2 * HELD_PAIRS):
                pairs = [_sums(*(np.concatenate(x) for x in zip(*pairs)))]
                if last or len(pairs[0][0]) > HELD_PAIRS:
                    yield often(*pairs[0])
                    pairs = []

        for b in batches:
            learn, at = b.column(0).to_numpy(zero_copy_only=False), 0
            for some in _parts(_bytes_of(b.column(1))):
                word, size = tokens_of(some)
                before = np.r_[START, word[:-1]]
                before[np.cumsum(size) - size] = START
                context = _context(before)
                held.append(np.unique((context.astype(np.uint64) << np.uint64(32)) | _shards(word, context, shards, hot).astype(np.uint64)))
                teaches = np.repeat(learn[at : at + len(some)], size)
                both = np.flatnonzero(_found(hot.word, word)[1] & teaches)
                both = both[_found(frequent, before[both])[1]]
                pairs.append(_sums(_pair(word[both], context[both]), np.ones(len(both), np.int64)))
                at += len(some)
                yield from merged(False)
        yield from merged(True)

    return docs.mapInArrow(run, PAIRS)


def frequent_pairs(seen: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, counts) of the pairs that occur more than ``most`` times; there are at most N / most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pair, n in zip(b.column(0), b.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(pair.as_buffer(), "<i8")), pa.array(np.frombuffer(n.as_buffer(), "<i8"))], ["pair", "n"])

    found = seen.where("bucket = -1").select("context", "value").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    got = sorted((int(r["pair"]) & 0xFFFFFFFFFFFFFFFF, int(r["n"])) for r in found.collect())
    return np.array([p for p, _ in got], dtype=np.uint64), np.array([n for _, n in got], dtype=np.int64)


def counts_of_shards(counts: DataFrame, seen: DataFrame, buckets: int) -> DataFrame:
    """Rows as ROUTED without texts: for each shard its predecessors (context) and how often each occurs (owner)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, totals, pairs = None, [], []

        def out() -> pa.RecordBatch:
            context, n = _sums(*(np.concatenate(x) for x in zip(*totals)))
            need = np.unique(np.concatenate([np.zeros(0, np.uint64), *pairs]))
            need = need[_found(context, (need & np.uint64(0xFFFFFFFF)).astype("<u4"))[1]]  # others are unknown
            shard, who = (need >> np.uint64(32)).astype(np.int32), (need & np.uint64(0xFFFFFFFF)).astype("<u4")
            n = n[np.searchsorted(context, who)].astype("<i8")
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, dtype=np.int64)
            ends = np.r_[cuts[1:], len(shard)].astype(np.int64)
            none = pa.nulls(len(cuts), pa.binary())
            packed = [pa.array([c[i:j].tobytes() for i, j in zip(cuts, ends)], pa.binary()) for c in (who, n)]
            return pa.RecordBatch.from_arrays([pa.array(shard[cuts], pa.int32()), none, none, none, none, *packed], [x.split()[0] for x in ROUTED.split(", ")])

        for b in batches:
            for bucket, context, value, is_count in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != last:
                    if totals:
                        yield out()
                    last, totals, pairs = bucket, [], []
                context = np.frombuffer(context, "<u4")
                if is_count:
                    totals.append((context, np.frombuffer(value, "<i8")))
                else:
                    pairs.append((np.frombuffer(value, "<u4").astype(np.uint64) << np.uint64(32)) | context)
                    if len(pairs) > 1 and sum(map(len, pairs[1:])) > max(HELD_PAIRS, len(pairs[0])):
                        pairs = [np.unique(np.concatenate(pairs))]
        if totals:
            yield out()

    return counts.unionByName(seen.where("bucket >= 0")).repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, ROUTED)


SUMS = ["key", "tokens", "known", "base", "score"]
KINDS = ["<i8", "<i8", "<i8", "<f8", "<f8"]


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each text over shards, from packed rows sorted by bucket."""
    last, held = None, None

    def out() -> pa.RecordBatch:
        key, *sums = held
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, *sums)], ["key", "n_tokens", "n_known", "base", "score"])

    for b in batches:
        for i, bucket in enumerate(b.column(0).to_pylist()):
            new = [np.frombuffer(b.column(1 + c)[i].as_buffer(), dtype=kind) for c, kind in enumerate(KINDS)]
            if bucket != last:
                if held is not None:
                    yield out()
                last, held = bucket, [x[:0] for x in new]
            key, at = np.unique(np.concatenate([held[0], new[0]]), return_inverse=True)
            sums = [np.bincount(at, np.concatenate([x, y]), len(key)) for x, y in zip(held[1:], new[1:])]
            held = [key, *(s.astype(kind) for s, kind in zip(sums, KINDS[1:]))]
    if held is not None:
        yield out()


@dataclass(frozen=True)
class Plan:
    """What all passes over a corpus share: N, V, its words (word, n), the number of shards and the frequent ones."""

    n: int
    v: int
    words: DataFrame
    shards: int
    hot: Hot


@dataclass(frozen=True)
class Model:
    """A plan and its tries: a table (shard, trie) in the shared folder."""

    plan: Plan
    tries: DataFrame


def _keyed(docs: DataFrame, learn: Column, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(texts (key, learn, text), their ids (key, learn, id, copies)): a row's key is a hash of id and text, which equal rows share."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text)
    teaches = F.coalesce(learn, F.lit(False))
    rows = docs.select(key.alias("key"), teaches.alias("learn"), text.alias("text"))
    ids = docs.select(F.col(id_col).alias("id"), key.alias("key"), teaches.alias("learn")).groupBy("key", "learn", "id").agg(F.count(F.lit(1)).alias("copies"))
    return rows, written(ids, "ids")


def _plan(rows: DataFrame, ids: DataFrame) -> tuple[Plan, DataFrame]:
    """(plan, counts of predecessors for the shards) of texts (key, learn, text)."""
    words = written(count_words(rows.where("learn").select("text")), "words")
    total = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = int(total["n"] or 0), int(total["v"])
    taught = ids.agg(F.sum(F.col("learn").cast("int") * F.col("copies")).alias("t"), F.sum("copies").alias("all")).first()
    every = n * (taught["all"] or 0) / max(taught["t"] or 0, 1) if n else 50_000_000
    shards = max(1, int(every // SHARD_TOKENS) + 1)
    most = max(1, n // (4 * shards))
    found = sorted((int(r["word"]) & 0xFFFFFFFFFFFFFFFF, int(r["n"])) for r in words.where(F.col("n") > most).collect())  # fewer than 4 a shard
    word, count = np.array([h for h, _ in found], dtype=np.uint64), np.array([c for _, c in found], dtype=np.int64)
    spread = np.minimum(shards, -(-count * 4 * shards // max(n, 1)))
    hot = Hot(word, count, spread, word[:0], count[:0])
    seen = written(seen_contexts(rows.select("learn", "text"), shards, hot, shards), "seen")
    hot = Hot(word, count, spread, *frequent_pairs(seen, most))
    return Plan(n, v, words, shards, hot), counts_of_shards(count_contexts(words, shards), seen, shards)


def _by_shard(dealt: DataFrame, shards: int, done, schema: str) -> DataFrame:
    """``done`` (rows of a shard -> record batch or None) for each shard: one task each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and held[0]["shard"] != r["shard"]:
                    if (out := done(held)) is not None:
                        yield out
                    held = []
                held.append(r)
        if held and (out := done(held)) is not None:
            yield out

    return dealt.repartitionById(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, schema)


def _sums_of_texts(dealt: DataFrame, plan: Plan, rows: int) -> DataFrame:
    """(key, n_tokens, n_known, base, score): sums over each key's texts."""
    n, v, hot, buckets = plan.n, plan.v, plan.hot, max(1, rows // BUCKET_ROWS)

    def done(held: list[dict]) -> pa.RecordBatch | None:
        if all(r["doc"] is None for r in held):
            return None
        got, tokens, seen, base, score = score_shard(held, n, v, hot)
        bucket = (got.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        cols = [c[order] for c in (got, tokens.astype(np.int64), seen, base, score)]
        some = [i for i in range(buckets) if ends[i] < ends[i + 1]]
        packed = [pa.array([c[ends[i] : ends[i + 1]].tobytes() for i in some], pa.binary()) for c in cols]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *packed], ["bucket", *SUMS])

    parts = _by_shard(dealt, plan.shards, done, "bucket int, " + ", ".join(f"{c} binary" for c in SUMS))
    return parts.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_add_up, "key bigint, n_tokens bigint, n_known bigint, base double, score double")


def _given_back(ids: DataFrame, sums: DataFrame, n: int, id_col: str) -> DataFrame:
    """A row for each row of the table, from the sums over equal rows."""
    copies = ids.join(ids.groupBy("key").agg(F.sum("copies").alias("of_key")), "key")
    joined = copies.join(sums, "key").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    each = lambda c: F.col(c) / F.col("of_key")
    return joined.select(
        F.col("id").alias(id_col), each("n_tokens").cast("bigint").alias("n_tokens"), each("n_known").cast("bigint").alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        each("base").alias("base_score"), each("score").alias("score"),
    )


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row; ``learn``: rows to learn from."""
    rows, ids = _keyed(docs, learn, id_col, text_col)
    plan, contexts = _plan(rows, ids)
    dealt = route(rows, plan.shards, plan.hot).unionByName(contexts)
    return _given_back(ids, _sums_of_texts(dealt, plan, ids.count()), plan.n, id_col)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of all rows, as a table that later jobs can score other tables by."""
    rows, ids = _keyed(docs, F.lit(True), id_col, text_col)
    plan, contexts = _plan(rows, ids)
    n, v, hot = plan.n, plan.v, plan.hot

    def done(held: list[dict]) -> pa.RecordBatch | None:
        texts = [r for r in held if r["doc"] is not None]
        if not texts:
            return None
        data, _ = trie_of(_tokens_in(texts), *_context_counts([r for r in held if r["doc"] is None], hot), n, v, hot)
        return pa.RecordBatch.from_arrays([pa.array([held[0]["shard"]], pa.int32()), pa.array([data], pa.binary())], ["shard", "trie"])

    dealt = route(rows, plan.shards, hot).unionByName(contexts)
    return Model(plan, written(_by_shard(dealt, plan.shards, done, "shard int, trie binary"), "tries"))


def score(model: Model, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows as of :func:`score_texts` for another table; base scores are as exact as the model's 16 bits."""
    plan = model.plan
    rows, ids = _keyed(docs, F.lit(False), id_col, text_col)
    contexts = counts_of_shards(count_contexts(plan.words, plan.shards), seen_contexts(rows.select("learn", "text"), plan.shards, plan.hot, plan.shards), plan.shards)
    null = F.lit(None).cast("binary")
    tries = model.tries.select("shard", null.alias("doc"), null.alias("learn"), F.col("trie").alias("word"), null.alias("run"), null.alias("context"), null.alias("owner"))
    dealt = route(rows, plan.shards, plan.hot).unionByName(contexts).unionByName(tries)
    return _given_back(ids, _sums_of_texts(dealt, plan, ids.count()), plan.n, id_col)


def query(spark, sf_dir: str) -> DataFrame:
    held = F.coalesce(id_bucket("doc_id", 7) == 2, F.lit(False))
    out = score_texts(table(spark, sf_dir, "documents"), ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
