"""Quality classifier: a byte-level convolutional network in numpy.

A byte is embedded in DIM numbers; learned filters of WIDTH bytes move over the text by STEP bytes;
each chunk of CHUNK windows (chunks overlap, and together cover the whole text) keeps the largest
response of every filter.  The largest and the mean of these over a text's chunks go into one
logistic unit: the probability of label 1.

It learns on the driver from whole texts of a bounded sample of labelled rows: at most ``sample`` of
each label, those with the smallest hash of their id.  Losses are weighted by how often each label
occurs among all labelled rows, so scores are probabilities under the true shares.  Learning and
scoring walk a long text in segments of SEGMENT chunks, and keep the largest and the sum as they
go: memory does not grow with a text beyond its bytes, and the results are those of the whole.

Defined results: null texts count as empty, and an empty text gets the score of a text of zero
bytes; repeated rows are kept; without labelled rows of both kinds, the score of all is the smoothed
share of label 1 (0.5 without any); a doc_id labelled twice has the smaller label; null
labels are ignored; an empty table gives no rows; other columns are ignored, and kept by
:func:`with_score`, but for one with the name of the new column, which it replaces; a null id is not held out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import id_bucket, table

DIM, STEP, WIDTH, FILTERS = 4, 4, 8, 16
#: Windows in a chunk and from one chunk to the next: 1024 bytes, 128 of them shared.
CHUNK, CHUNK_STEP = 256, 224
#: Chunks of a segment: about a megabyte.
SEGMENT = 1024
#: The sample's bound: rows of each label.
SAMPLE = 700
EPOCHS, BATCH, RATE = 24, 64, 0.02
BATCH_BYTES = 1 << 20
THRESHOLD = 0.3


@dataclass
class Net:
    embed: np.ndarray  # [256, DIM]
    first: np.ndarray  # [STEP * DIM, FILTERS]: the first half of each filter
    second: np.ndarray
    bias: np.ndarray
    out: np.ndarray  # [2 * FILTERS]
    base: np.ndarray  # [1]

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.first, self.second, self.bias, self.out, self.base]


def new_net(seed: int = 7) -> Net:
    rng = np.random.default_rng(seed)
    f = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    return Net(f(256, DIM) * 4, f(STEP * DIM, FILTERS), f(STEP * DIM, FILTERS), np.zeros(FILTERS, np.float32), f(2 * FILTERS), np.zeros(1, np.float32))


def _segments(text: bytes) -> Iterator[tuple[bytes, int]]:
    """(bytes, blocks of STEP bytes) of a text's chunks, SEGMENT at a time; the last is to be padded."""
    windows = max(1, -(-len(text) // STEP))
    chunks = max(1, -(-(windows - CHUNK) // CHUNK_STEP) + 1)
    for at in range(0, chunks, SEGMENT):
        first = at * CHUNK_STEP
        last = windows if at + SEGMENT >= chunks else (at + SEGMENT - 1) * CHUNK_STEP + CHUNK
        yield text[first * STEP : (last + 1) * STEP], last + 1 - first


def _batches(texts: list[bytes]) -> Iterator[tuple[list[int], list[tuple[bytes, int]]]]:
    """(text of each segment, segments), a megabyte or two at a time."""
    owner, some, n = [], [], 0
    for i, t in enumerate(texts):
        for seg in _segments(t):
            owner.append(i)
            some.append(seg)
            n += len(seg[0])
            if n > BATCH_BYTES:
                yield owner, some
                owner, some, n = [], [], 0
    if some:
        yield owner, some


def _layout(segments: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, chunk starts, chunk ends, chunks of each segment); each segment padded to whole windows."""
    blocks = np.array([n for _, n in segments])
    data = b"".join(t.ljust(n * STEP, b"\0") for t, n in segments)
    start = np.cumsum(blocks) - blocks
    windows = blocks - 1
    chunks = np.maximum(1, -(-(windows - CHUNK) // CHUNK_STEP) + 1)
    nth = np.arange(int(chunks.sum())) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    lo = np.repeat(start, chunks) + nth * CHUNK_STEP
    hi = np.minimum(lo + CHUNK, np.repeat(start + windows, chunks))
    return np.frombuffer(data, dtype=np.uint8), lo, hi, chunks


def _responses(net: Net, data: np.ndarray) -> np.ndarray:
    """[window, filter] responses before the maximum; the last row stands for no window."""
    x = net.embed[data].reshape(-1, STEP * DIM)
    y = x @ net.first
    y[:-1] += (x @ net.second)[1:]
    y += net.bias
    np.maximum(y, 0, out=y)
    return y


def _pool(y: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    at = np.empty(2 * len(lo), dtype=np.int64)
    at[::2], at[1::2] = lo, hi
    return np.maximum.reduceat(y, at, axis=0)[::2]


def _features(net: Net, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features, chunks) of each whole text: the largest and the mean of its chunks' maxima."""
    top, total, count = np.zeros((len(texts), FILTERS), np.float32), np.zeros((len(texts), FILTERS)), np.zeros(len(texts), np.int64)
    for owner, segments in _batches(texts):
        data, lo, hi, chunks = _layout(segments)
        pooled = _pool(_responses(net, data), lo, hi)
        at = np.cumsum(chunks) - chunks
        np.maximum.at(top, owner, np.maximum.reduceat(pooled, at, axis=0))
        np.add.at(total, owner, np.add.reduceat(pooled, at, axis=0, dtype=np.float64))
        np.add.at(count, owner, chunks)
    return np.concatenate([top, (total / np.maximum(count, 1)[:, None]).astype(np.float32)], axis=1), count


def score(net: Net, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 of each whole text."""
    if not texts:
        return np.zeros(0)
    z = _features(net, texts)[0] @ net.out + net.base
    return 1 / (1 + np.exp(-z.astype(np.float64)))


def _gradients(net: Net, texts: list[bytes], label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the sum of weighted log losses, by each of the net's parameters."""
    feats, count = _features(net, texts)
    z = feats @ net.out + net.base
    dz = ((1 / (1 + np.exp(-z)) - label) * weight).astype(np.float32)
    grads = [np.zeros_like(net.embed), np.zeros_like(net.first), np.zeros_like(net.second), np.zeros_like(net.bias)]
    left = np.ones((len(texts), FILTERS), bool)  # a maximum's share goes to the first chunk that has it
    for owner, segments in _batches(texts):
        data, lo, hi, chunks = _layout(segments)
        y = _responses(net, data)
        pooled = _pool(y, lo, hi)
        doc = np.repeat(owner, chunks)
        top = pooled >= feats[doc, :FILTERS]
        at, f = np.nonzero(top)
        first = np.unique(doc[at] * FILTERS + f, return_index=True)[1]
        first = first[left[doc[at[first]], f[first]]]
        top[:] = False
        top[at[first], f[first]] = True
        left[doc[at[first]], f[first]] = False
        dpool = dz[doc, None] * (top * net.out[:FILTERS] + net.out[FILTERS:] / count[doc, None])
        dpool = np.where(pooled > 0, dpool, 0).astype(np.float32)
        # The window that gave each chunk's maximum, for each filter.
        offset = np.minimum(lo[:, None] + np.arange(CHUNK), hi[:, None] - 1)
        win = np.take_along_axis(offset, y[offset].argmax(axis=1), axis=1)
        cells = data.reshape(-1, STEP)
        for half, grad, shift in ((net.first, grads[1], 0), (net.second, grads[2], 1)):
            seen = cells[win + shift]  # [chunk, filter, STEP]
            x = net.embed[seen].reshape(*win.shape, STEP * DIM)
            grad += np.einsum("cf,cfd->df", dpool, x)
            dx = (dpool[:, :, None] * half.T[None]).reshape(*win.shape, STEP, DIM)
            for d in range(DIM):
                grads[0][:, d] += np.bincount(seen.ravel(), dx[..., d].ravel(), 256).astype(np.float32)
        grads[3] += dpool.sum(axis=0)
    return [*grads, dz @ feats, dz.sum(keepdims=True)]


def train(texts: list[bytes], labels: np.ndarray, share: float, seed: int = 7) -> Net:
    """Adam on the weighted log loss; share: of label 1 among all labelled rows."""
    net = new_net(seed)
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, dtype=np.float32)
    one = labels.mean()
    weight = np.where(labels == 1, share / one, (1 - share) / (1 - one)).astype(np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step, steps = 0, EPOCHS * -(-len(texts) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            grads = _gradients(net, [texts[i] for i in some], labels[some], weight[some] / len(some))
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for p, g, (m, v) in zip(net.parameters(), grads, moments):
                g = g + 1e-4 * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", usable=None) -> Net | float:
    """A net, or the share of label 1 where there are not both labels.  usable: which label rows may be learnt from."""
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if usable is not None:
        rows = rows.where(usable)
    rows = rows.groupBy(id_col).agg(F.min(label_col).cast("int").alias("_label"))
    counts = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    if len(counts) < 2:
        return share
    ids = [r for k in (0, 1) for r in rows.where(F.col("_label") == k).orderBy(F.xxhash64(id_col), id_col).limit(sample).collect()]
    spark = docs.sparkSession
    chosen = spark.createDataFrame(ids, rows.schema)
    own = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    found = own.join(F.broadcast(chosen), id_col).select(id_col, "_label", F.coalesce("_text", F.lit("")).cast("binary").alias("_data"))
    got = found.groupBy(id_col, "_label").agg(F.min("_data").alias("_data")).collect()
    got.sort(key=lambda r: r[id_col])
    label = np.array([r["_label"] for r in got])
    if len(set(label.tolist())) < 2:
        return share
    return train([bytes(r["_data"]) for r in got], label, share)


def with_score(docs: DataFrame, model: Net | float, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with one more column: the probability of label 1 of each whole text."""
    if name == text_col:
        raise ValueError("the score needs a name of its own")
    docs = docs.drop(name)
    if isinstance(model, float):
        return docs.withColumn(name, F.lit(model))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).cast(pa.binary())
            for row in range(0, len(b), 1024):
                part = b.slice(row, 1024)
                got = score(model, [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts[row : row + 1024]])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got)], [*part.schema.names, name])

    out = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(run, out)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), usable=id_bucket("doc_id", 5) != 0)
    scored = with_score(docs, model)
    return scored.select("doc_id", F.coalesce(id_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
