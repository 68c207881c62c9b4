"""Packing: small files are put together before they are chunked.

Greedy: in order of the path, a file joins the open pack, and a pack closes when it has reached the
target.  That is serial, but over path and size alone.  Files fall into *lanes* by a prefix of their
path (their top directory, say); lanes are packed independently, each in one pass
over its sorted sizes: a built-in fold would have to gather a lane into one array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.bytes import joined
from cairn.model import PACK_TARGET, SMALL


def small_files(entries: DataFrame, threshold: int = SMALL) -> DataFrame:
    return entries.where(~F.col("is_dir") & (F.col("size") < threshold))


def large_files(entries: DataFrame, threshold: int = SMALL) -> DataFrame:
    return entries.where(~F.col("is_dir") & (F.col("size") >= threshold))


def assemble(files: DataFrame, target: int = PACK_TARGET, lane: Column | None = None) -> DataFrame:
    """(lane, path, size, pack, start, end): each file's pack in its lane and place in the pack.

    A member goes into the open pack, and only then is the target tested."""
    lane = F.lit("") if lane is None else lane
    rows = files.select(lane.alias("lane"), "path", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, pack, at = None, 0, 0
        for b in batches:
            packs, starts = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for i, (own, size) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                if own != lane:
                    lane, pack, at = own, 0, 0
                packs[i], starts[i] = pack, at
                at += size
                if at >= target:
                    pack, at = pack + 1, 0
            ends = starts + b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(packs), pa.array(starts), pa.array(ends)], ["lane", "path", "size", "pack", "start", "end"])

    dealt = rows.repartition(F.col("lane")).sortWithinPartitions("lane", "path")
    return dealt.mapInArrow(run, "lane string, path string, size bigint, pack bigint, start bigint, end bigint")


def pack_contents(members: DataFrame, files: DataFrame) -> DataFrame:
    """(lane, pack, content): the bytes of each pack, of its members in order."""
    rows = members.select("lane", "pack", "start", "path").join(files.select("path", "content"), "path")
    return rows.groupBy("lane", "pack").agg(joined("content", "start, path").alias("content"))


def covering(members: DataFrame, chunks: DataFrame) -> DataFrame:
    """(lane, path, pos, chunk_id, pack_offset): the chunks of a pack that hold some of a member.

    chunks: (lane, pack, pos, start, len, chunk_id).  Pack and lane are equal, the ranges overlap;
    pack_offset is the member's start within the first of its chunks.  Empty members have none."""
    m = members.select("lane", "pack", "path", F.col("start").alias("m_start"), F.col("end").alias("m_end"))
    c = chunks.select("lane", "pack", "pos", F.col("start").alias("c_start"), (F.col("start") + F.col("len")).alias("c_end"), "chunk_id")
    hit = m.join(c, ["lane", "pack"]).where((F.col("c_start") < F.col("m_end")) & (F.col("m_start") < F.col("c_end")) & (F.col("m_end") > F.col("m_start")))
    first = F.min("c_start").over(Window.partitionBy("lane", "path"))
    return hit.select("lane", "path", "pos", "chunk_id", (F.col("m_start") - first).alias("pack_offset"))
