"""What several operators of this package need: reading tables and cutting lineage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.scratch import forget, shared_dir, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: 64-bit words (8 MB) of a filter, whatever is in it: a full one lets more pass.
FILTER_WORDS = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A splitmix finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _probe(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bits) of each key in a blocked Bloom filter."""
    h = mixed(key.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    one = np.uint64(1)
    bits = (one << (h & np.uint64(63))) | (one << ((h >> np.uint64(6)) & np.uint64(63))) | (one << ((h >> np.uint64(12)) & np.uint64(63)))
    return (h >> np.uint64(18)) % np.uint64(FILTER_WORDS), bits


def passes(words: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys (64 bits) may be in the filter: all that are, and few others until it fills up."""
    word, bits = _probe(key)
    return (words[word] & bits) == bits


def filter_of(keys: DataFrame, column: str) -> Broadcast:
    """A filter over a column of 64-bit numbers, of a fixed size: tasks combine theirs, and at most FILTER_WORDS words reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(FILTER_WORDS, np.uint64)
        for b in batches:
            np.bitwise_or.at(words, *_probe(b.column(0).to_numpy()))
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(words[some].view(np.int64))], ["word", "bits"])

    got = keys.select(column).mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(FILTER_WORDS, np.uint64)
    words[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(words)


def id_bucket(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``: how contracts split rows into folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
