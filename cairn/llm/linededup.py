"""Line dedup by a log-template tree.

Lines become tokens (runs of what is not white space); tokens with a digit are variable fields and
all alike.  The tree has a fixed depth: the number of tokens, then the DEPTH leading tokens lead to
a leaf.  In a leaf a template generalises further: the tokens after the leading ones are cut into
blocks of a quarter of them (rounded down), and each template leaves one block open.  So lines meet in a
template if they agree in at least three quarters of those tokens, and differ in one block only.
Every node of the tree is named by a hash of its path, so that a line belongs to a handful of
templates, whatever else its leaf holds: a leaf is never gathered, and counting is a sum a template.

A line recurs, and goes from all documents but the one with the smallest id, if

* the line itself is found in at least ``min_docs`` documents, being long: ``min_tokens`` tokens or LONG_CHARS code points; or
* the line itself is found in at least ``short_docs`` documents, being of SHORT_CHARS code points at least; or
* one of its templates is found in at least ``template_docs`` documents.  Templates need CONSTANTS
  tokens that are no fields, and as many of these as of others.

Documents are counted, not lines: however many lines of one text share a template, they count once.
Tasks combine equal templates before they shuffle.  A filter of fixed size over the recurring ones goes to
the tasks; what passes it meets the exact table in a join.
Templates are told apart by 62 bits of hash.  Texts shuffle once, to meet the numbers of the lines they lose.

Defined results: lines shorter than all of these, or without a letter, always stay; null texts stay
null; empty texts stay empty; a text that loses all its lines becomes empty; repeated rows count
as documents and are kept; rows with a null id count as documents, but come after all others
when the first is chosen; an empty table gives no rows; other columns stay as they are, but for one
with the name of the new column, which it replaces."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import filter_of, mixed, passes, table, written

DEPTH, QUARTER = 3, 4
MIN_DOCS, TEMPLATE_DOCS, SHORT_DOCS = 2, 3, 10
MIN_TOKENS, LONG_CHARS, SHORT_CHARS, CONSTANTS = 4, 24, 12, 4
#: Bytes of text taken apart at a time.
PART_BYTES = 1 << 21
DIGIT, LETTER = re.compile(rb"[0-9]"), re.compile(rb"[A-Za-z\x80-\xff]")
FIELD = np.uint64(xxhash.xxh64_intdigest(b" field "))  # no token has blanks
LAST = np.iinfo(np.int64).max
#: The two lowest bits of a key say what it stands for.
LONG, SHORT, TEMPLATE = 0, 1, 2


def _sums(x: np.ndarray) -> np.ndarray:
    return np.r_[np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype)]


def keys_of(texts: list[bytes], min_tokens: int = MIN_TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, line, key): each line of each text with the keys of all it belongs to."""
    owner, number, tokens, kind, numeric = [], [], [], [], []
    for i, text in enumerate(texts):
        for n, line in enumerate(text.split(b"\n")):
            if len(line) < SHORT_CHARS or not LETTER.search(line):
                continue
            words = line.split()
            k = LONG
            if len(words) < min_tokens:
                chars = len(line.strip().decode("utf-8", "replace"))
                if chars < SHORT_CHARS:
                    continue
                k = LONG if chars >= LONG_CHARS else SHORT
            if DIGIT.search(line):
                numeric.append(len(tokens))
            owner.append(i)
            number.append(n)
            tokens.append(words)
            kind.append(k)
    owner, number, kind = np.array(owner, np.int64), np.array(number, np.int32), np.array(kind, np.uint64)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    end = np.cumsum(size)
    start = end - size
    raw = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(tokens)), np.uint64, int(size.sum()))
    field = np.zeros(len(raw), np.int64)
    for i in numeric:
        field[start[i] : end[i]] = [DIGIT.search(t) is not None for t in tokens[i]]
    place = ((np.arange(len(raw)) - np.repeat(start, size)).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    whole = _sums(mixed(raw + place))
    masked = _sums(mixed(np.where(field == 1, FIELD, raw) + place))
    fields = _sums(field)
    seal = lambda total, salt: mixed(mixed(total + size_of) + salt) & ~np.uint64(3)

    size_of = size.astype(np.uint64)
    out = [(owner, number, seal(whole[end] - whole[start], np.uint64(0)) | kind)]

    lost = fields[end] - fields[start]
    some = np.flatnonzero((size >= min_tokens) & (lost > 0) & (size - lost >= CONSTANTS) & (2 * lost <= size))
    size_of = size[some].astype(np.uint64)
    out.append((owner[some], number[some], seal(masked[end[some]] - masked[start[some]], np.uint64(1)) | np.uint64(TEMPLATE)))

    width = (size - DEPTH) // QUARTER
    some = np.flatnonzero((width > 0) & (size >= min_tokens))
    blocks = -(-(size[some] - DEPTH) // width[some])
    at = np.repeat(some, blocks)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    a = start[at] + DEPTH + nth * width[at]
    b = np.minimum(a + width[at], end[at])
    lost = fields[end[at]] - fields[start[at]] + (b - a) - (fields[b] - fields[a])  # fields, and tokens left open
    good = (size[at] - lost >= CONSTANTS) & (2 * lost <= size[at])
    at, nth, a, b = at[good], nth[good], a[good], b[good]
    size_of = size[at].astype(np.uint64)
    total = masked[end[at]] - masked[start[at]] - (masked[b] - masked[a])
    out.append((owner[at], number[at], seal(total, nth.astype(np.uint64) + np.uint64(2)) | np.uint64(TEMPLATE)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _parts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of about PART_BYTES; null texts are empty, which have no lines to count."""
    at, some, n = 0, [], 0
    for t in column.cast(pa.binary()):
        some.append(t.as_buffer().to_pybytes() if t.is_valid else b"")
        n += len(some[-1])
        if n > PART_BYTES:
            yield at, some
            at, some, n = at + len(some), [], 0
    if some:
        yield at, some


def recurring_keys(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, template_docs: int = TEMPLATE_DOCS, short_docs: int = SHORT_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, first_id): lines and templates that recur and the smallest id that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(int(LAST)).to_numpy()
            for at, texts in _parts(batch.column(1)):
                owner, _, key = keys_of(texts, min_tokens)
                order = np.lexsort((owner, key))
                owner, key = owner[order], key[order]
                once = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]) if len(key) else order
                owner, key = owner[once], key[once]
                new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else order
                first = np.minimum.reduceat(ids[at + owner], new) if len(key) else ids[:0]
                n = np.diff(np.r_[new, len(key)])
                yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), pa.array(n), pa.array(first)], ["key", "docs", "first_id"])

    found = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, "key bigint, docs bigint, first_id bigint")
    kind = F.col("key").bitwiseAND(F.lit(3))
    least = F.when(kind == LONG, min_docs).when(kind == SHORT, short_docs).otherwise(template_docs)
    return found.groupBy("key").agg(F.sum("docs").alias("docs"), F.min("first_id").alias("first_id")).where(F.col("docs") >= least).select("key", "first_id")


def possible_lines(docs: DataFrame, held: Broadcast, min_tokens: int = MIN_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, n, key): lines with a key that passes the filter."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _parts(batch.column(2)):
                owner, number, key = keys_of(texts, min_tokens)
                hit = passes(held.value, key)
                take = pa.array(at + owner[hit])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(number[hit]), pa.array(key[hit].view(np.int64))], ["id", "text_key", "n", "key"])

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, text_key bigint, n int, key bigint")


def drop_recurring(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, template_docs: int = TEMPLATE_DOCS, short_docs: int = SHORT_DOCS,
    id_col: str = "doc_id", text_col: str = "text", dropped: str = "n_dropped",
) -> DataFrame:
    """``docs`` with shortened texts and one more column, the number of lines that a text has lost."""
    # Written, so that the join below reads plain shuffles, which Spark can split where a line is frequent.
    again = written(recurring_keys(docs, min_docs, min_tokens, template_docs, short_docs, id_col, text_col), "recurring")
    hits = possible_lines(docs, filter_of(again, "key"), min_tokens, id_col, text_col).join(again, "key").where(F.coalesce(F.col("id").cast("bigint"), F.lit(int(LAST))) != F.col("first_id"))
    lost = hits.groupBy("id", "text_key").agg(F.collect_set("n").alias("lost"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("row_id"), F.xxhash64(text_col).alias("row_key"))
    both = rows.join(lost, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_key") == F.col("text_key")), "left")
    own = F.col("row").getField(text_col)
    lines = F.split(own, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "lost")
    text = F.when(F.col("lost").isNull(), own).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    columns = [text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c != dropped]
    return both.select(*columns, F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).alias(dropped))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n", -1)).alias("n_lines"))
    return drop_recurring(docs).select("doc_id", "n_lines", "n_dropped", "text")


#: Templates as text: fields and what is left open become marks that no token holds.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
l AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM d WHERE text IS NOT NULL),
t AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS toks, length(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) AS chars FROM l
  WHERE octet_length(encode(line)) >= {SHORT_CHARS} AND regexp_matches(line, '[A-Za-z]|[^\x00-\x7F]')),
k AS (SELECT *, len(toks)::BIGINT AS size, list_transform(toks, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN chr(1) || 'f' ELSE x END) AS masked FROM t WHERE len(toks) >= {MIN_TOKENS} OR chars >= {SHORT_CHARS}),
f AS (SELECT *, len(list_filter(masked, lambda x: x = chr(1) || 'f'))::BIGINT AS fields, (size - {DEPTH}) // {QUARTER} AS width FROM k),
b AS (SELECT *, unnest(range(0, CASE WHEN width > 0 AND size >= {MIN_TOKENS} THEN (size - {DEPTH} + width - 1) // width ELSE 0 END)) AS j FROM f),
o AS (SELECT *, list_transform(masked, lambda x, i: CASE WHEN i > {DEPTH} + j * width AND i <= {DEPTH} + (j + 1) * width THEN chr(1) || 'o' ELSE x END) AS shown FROM b),
keys AS (
  SELECT rid, doc_id, n, CASE WHEN size >= {MIN_TOKENS} OR chars >= {LONG_CHARS} THEN 'L' ELSE 'S' END || array_to_string(toks, ' ') AS key,
    CASE WHEN size >= {MIN_TOKENS} OR chars >= {LONG_CHARS} THEN {MIN_DOCS} ELSE {SHORT_DOCS} END AS need FROM f
  UNION ALL SELECT rid, doc_id, n, 'M' || array_to_string(masked, ' '), {TEMPLATE_DOCS} FROM f WHERE fields > 0 AND size >= {MIN_TOKENS} AND size - fields >= {CONSTANTS} AND 2 * fields <= size
  UNION ALL SELECT rid, doc_id, n, 'T' || j || ' ' || array_to_string(shown, ' '), {TEMPLATE_DOCS} FROM o
    WHERE len(list_filter(shown, lambda x: x NOT IN (chr(1) || 'f', chr(1) || 'o'))) >= {CONSTANTS} AND 2 * len(list_filter(shown, lambda x: x NOT IN (chr(1) || 'f', chr(1) || 'o'))) >= size),
again AS (SELECT key, min(doc_id) AS first FROM keys GROUP BY key HAVING count(DISTINCT rid) >= any_value(need)),
lost AS (SELECT DISTINCT rid, n FROM keys JOIN again USING (key) WHERE doc_id IS DISTINCT FROM first),
kept AS (SELECT l.rid, string_agg(line, chr(10) ORDER BY l.n) FILTER (WHERE lost.n IS NULL) AS text, count(lost.n)::INTEGER AS gone FROM l LEFT JOIN lost ON l.rid = lost.rid AND l.n = lost.n GROUP BY l.rid)
SELECT doc_id, len(string_split(d.text, chr(10)))::INTEGER AS n_lines, coalesce(gone, 0)::INTEGER AS n_dropped, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text FROM d LEFT JOIN kept USING (rid)
"""
