"""Language identification of mixed text: scripts narrow candidates, Viterbi labels spans.

Words are runs of letters and marks.  The script of a word's first letter, by ranges of code
points, narrows its candidates to the languages that were seen to use that script.  A word's score
under a language is the sum of the log probabilities of its letters with their neighbours
(boundaries included), hashed into BUCKETS classes.  A Viterbi pass over a text's words picks the
sequence of languages with the best sum of scores less PENALTY for each switch; neighbouring words
of one label make a span.  All texts of a batch take their steps together, as numpy rows.

The model is counted over all texts that may be learnt from; its size depends on the number of
languages alone (BUCKETS + scripts numbers each), so it goes to every worker.

Defined results: ``und``, score 0 and no spans for null texts, texts without a letter, and
everything if nothing could be learnt; otherwise the language with the most letters (ties: the
first by name) and its share of the letters; rows with null language teach nothing; repeated
rows are kept; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import id_bucket, table

#: Words whose features are looked up at a time.
WORDS_AT_ONCE = 1 << 15
BUCKETS = 1 << 15
SMOOTHING, PENALTY = 0.5, 10.0
#: A language uses a script if at least this share of its letters is in it.
SCRIPT_SHARE = 0.01
#: Code points whose features are made at a time, and whose words take their steps together.
PART, TOGETHER = 1 << 19, 1 << 22
#: First code points of ranges of scripts (Unicode blocks), and their names.
RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1880, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"),
    (0x2C00, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Latin"),
    (0xFF66, "Kana"), (0xFFA0, "Other"), (0x20000, "Han"), (0x30000, "Other"),
]
SCRIPTS = list(dict.fromkeys(name for _, name in RANGES))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 2 for letters and 1 for marks, the lower case if that is one code point, the script."""
    n = 0x110000
    chars = [chr(i) for i in range(n)]
    kind = np.fromiter((2 if c.isalpha() else 1 if unicodedata.combining(c) or unicodedata.category(c)[0] == "M" else 0 for c in chars), dtype=np.uint8, count=n)
    low = np.fromiter((ord(x) if len(x := c.lower()) == 1 else i for i, c in enumerate(chars)), dtype=np.uint32, count=n)
    firsts = np.array([at for at, _ in RANGES])
    script = np.array([SCRIPTS.index(name) for _, name in RANGES], dtype=np.uint8)[np.searchsorted(firsts, np.arange(n), side="right") - 1]
    return kind, low, script


@dataclass
class Words:
    """The words of some texts: first code point, end and text of each, and the features of their letters."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    letters: np.ndarray  # letters of each word
    first: np.ndarray  # index of each word's first feature
    bucket: np.ndarray
    script: np.ndarray


def words_of(texts: list[str]) -> Words:
    """start and end count code points within each text."""
    kind, low, script = _tables()
    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    k = kind[cp]
    inside = k > 0
    edge = np.diff(inside.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.r_[0, np.cumsum(k == 2)]
    letters = sums[end] - sums[start]
    some = letters > 0
    start, end, letters = start[some], end[some], letters[some]
    # Features: a code point with its neighbours, zero beyond the word.
    size = end - start
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first, size) + np.repeat(start, size)
    here = low[cp[at]].astype(np.uint64)
    before, after = np.r_[np.uint64(0), here[:-1]], np.r_[here[1:], np.uint64(0)]
    before[first], after[first + size - 1] = 0, 0
    h = (before << np.uint64(42)) ^ (here << np.uint64(21)) ^ after
    h *= np.uint64(0x9E3779B97F4A7C15)
    bucket = (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    text = np.searchsorted(ends, start, side="right")
    base = np.r_[0, ends[:-1]][text]
    lead = np.where(k[start] == 2, start, np.minimum(start + 1, end - 1))
    return Words(start - base, end - base, text, letters, first, bucket, script[cp[lead]])


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # [BUCKETS, language]
    barred: np.ndarray  # [script, language]: added to a word's score


def _parts(texts: list[str], most: int) -> Iterator[list[str]]:
    some, n = [], 0
    for t in texts:
        some.append(t)
        n += len(t)
        if n > most:
            yield some
            some, n = [], 0
    if some:
        yield some


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", usable=None) -> Model:
    """Count over all rows with a language that ``usable`` allows."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if usable is not None:
        rows = rows.where(usable)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for b in batches:
            at = 0
            langs = b.column(0).to_pylist()
            for some in _parts(b.column(1).to_pylist(), PART):
                own = langs[at : at + len(some)]
                at += len(some)
                w = words_of(some)
                names = sorted(set(own))
                code = np.array([names.index(x) for x in own])[w.text]
                size = np.diff(np.r_[w.first, len(w.bucket)])
                grams = np.bincount(np.repeat(code, size) * BUCKETS + w.bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                letters = np.bincount(code * len(SCRIPTS) + w.script, w.letters, len(names) * len(SCRIPTS)).reshape(-1, len(SCRIPTS)).astype(np.int64)
                for i, name in enumerate(names):
                    found[name] = found.get(name, 0) + np.r_[grams[i], letters[i]]
        for name, n in found.items():
            cell = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(cell)), pa.array(cell.astype(np.int32)), pa.array(n[cell])], ["lang", "cell", "n"])

    counted = rows.select(F.col(lang_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(count, "lang string, cell int, n bigint")
    got = counted.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS + scripts rows a language at most
    langs = sorted(set(got.column("lang").to_pylist()))
    n = np.zeros((BUCKETS + len(SCRIPTS), len(langs)))
    if langs:
        at = np.searchsorted(np.array(langs), np.array(got.column("lang").to_pylist()))
        n[got.column("cell").to_numpy(), at] = got.column("n").to_numpy()
    grams, letters = n[:BUCKETS], n[BUCKETS:]
    logp = np.log((grams + SMOOTHING) / (grams.sum(axis=0) + SMOOTHING * BUCKETS)).astype(np.float32)
    uses = letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=0), 1)
    uses[~uses.any(axis=1)] = True  # nobody's script: all stay candidates
    return Model(langs, logp, np.where(uses, 0, -1e4).astype(np.float32))


def viterbi(score: np.ndarray, text: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The label of each word; score: [word, language], text: of each word, ascending."""
    n, langs = score.shape
    label = np.zeros(n, dtype=np.int64)
    if not n:
        return label
    start = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    size = np.diff(np.r_[start, n])
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    steps = int(size[0])
    active = np.searchsorted(-size, -np.arange(steps), side="left")  # texts with more than t words
    back = np.zeros((n, langs), dtype=np.int16)
    own = np.arange(langs, dtype=np.int16)
    best = score[start].copy()
    rows = np.arange(len(start))
    for t in range(1, steps):
        m = active[t]
        now = best[:m]
        top = now.argmax(axis=1)
        over = now[rows[:m], top][:, None] - penalty
        at = start[:m] + t
        stay = now >= over
        back[at] = np.where(stay, own, top[:, None])
        best[:m] = np.where(stay, now, over) + score[at]
    state = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        m = active[t]
        at = start[:m] + t
        label[at] = state[:m]
        state[:m] = back[at, state[:m]] if t else state[:m]
    return label


def word_scores(model: Model, w: Words) -> np.ndarray:
    """[word, language]: sums over a word's features, languages that do not use its script barred; WORDS_AT_ONCE words at a time."""
    out = np.empty((len(w.first), len(model.langs)), np.float32)
    for a in range(0, len(out), WORDS_AT_ONCE):
        own = w.first[a : a + WORDS_AT_ONCE]
        end = w.first[a + WORDS_AT_ONCE] if a + WORDS_AT_ONCE < len(w.first) else len(w.bucket)
        out[a : a + WORDS_AT_ONCE] = np.add.reduceat(model.logp[w.bucket[own[0] : end]], own - own[0], axis=0)
    return out + model.barred[w.script]


def identify(texts: list[str], model: Model) -> tuple[list[str], list[float], Words, np.ndarray]:
    """(language of each text, its share of the letters, words, label of each word)."""
    parts, scores, done = [], [], 0
    for some in _parts(texts, PART):
        w = words_of(some)
        scores.append(word_scores(model, w))
        w.text = w.text + done
        w.bucket, w.first = w.bucket[:0], w.first[:0]
        parts.append(w)
        done += len(some)
    join = lambda name: np.concatenate([getattr(p, name) for p in parts])
    all_words = Words(*(join(x) for x in ("start", "end", "text", "letters", "first", "bucket", "script")))
    label = viterbi(np.concatenate(scores), all_words.text)
    n = np.bincount(all_words.text * len(model.langs) + label, all_words.letters, len(texts) * len(model.langs)).reshape(len(texts), -1)
    top, total = n.argmax(axis=1), n.sum(axis=1)
    share = n[np.arange(len(texts)), top] / np.maximum(total, 1)
    return [model.langs[i] if k else "und" for i, k in zip(top, total)], share.tolist(), all_words, label


def _spans(words: Words, label: np.ndarray, texts: int, langs: list[str]) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(texts)]
    if len(label):
        new = np.r_[True, (label[1:] != label[:-1]) | (words.text[1:] != words.text[:-1])]
        at = np.flatnonzero(new)
        last = np.r_[at[1:], len(label)] - 1
        for t, a, b, k in zip(words.text[at].tolist(), words.start[at].tolist(), words.end[last].tolist(), label[at].tolist()):
            out[t].append({"start": a, "end": b, "lang": langs[k]})
    return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """(id, lang_pred, score[, spans]); spans: array of (start, end, lang), in code points."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for some in _parts([t or "" for t in b.column(1).to_pylist()], TOGETHER):
                if model.langs:
                    lang, share, words, label = identify(some, model)
                    found = _spans(words, label, len(some), model.langs) if spans else None
                else:
                    lang, share, found = ["und"] * len(some), [0.0] * len(some), [[]] * len(some)
                cols = [b.column(0).slice(at, len(some)), pa.array(lang), pa.array(share, pa.float64())]
                names = ["id", "lang_pred", "score"]
                if spans:
                    cols, names = [*cols, pa.array(found, shape)], [*names, "spans"]
                yield pa.RecordBatch.from_arrays(cols, names)
                at += len(some)

    more = ", spans array<struct<start:int,end:int,lang:string>>" if spans else ""
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double{more}").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, usable=id_bucket("doc_id", 4) != 2)
    out = predict(docs, model, spans=False)
    return out.select("doc_id", F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
