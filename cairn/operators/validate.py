"""Checks of untrusted tables: each returns the rows that break a rule, with the rule's name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions import paths
from cairn.functions.numbers import long
from cairn.model import ALGORITHMS, MAX_BLOCK, WRAPPERS

WIDE = "decimal(38,0)"


def bad_paths(entries: DataFrame) -> DataFrame:
    """(path, rule): paths that are not canonical, or occur twice."""
    canonical = F.coalesce(paths.normalized(F.col("path")) == F.col("path"), F.lit(False))
    wrong = entries.where(~canonical).select("path", F.lit("not canonical").alias("rule"))
    twice = entries.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("path", F.lit("duplicate").alias("rule"))
    return wrong.unionByName(twice)


def bad_bounds(rows: DataFrame) -> DataFrame:
    """Rows of (smallest, average, largest) that are no chunk bounds."""
    s, a, m = F.col("smallest"), F.col("average"), F.col("largest")
    fine = (s >= 4096) & (s <= a) & (a <= m) & (m <= 256 << 20) & (a.bitwiseAND(a - 1) == 0)
    return rows.where(~F.coalesce(fine, F.lit(False)))


def bad_ranges(rows: DataFrame, offset: str, length: str, end: Column) -> DataFrame:
    """Rows whose [offset, offset + length) is not inside [0, end); sums are wide, so nothing overflows."""
    o, n = F.col(offset).cast(WIDE), F.col(length).cast(WIDE)
    fine = (o >= 0) & (n >= 0) & (o + n <= end.cast(WIDE))
    return rows.where(~F.coalesce(fine, F.lit(False)))


def bad_extensions(rows: DataFrame, payload_len: int) -> DataFrame:
    """(extension_id, rule) of a directory of (extension_id, critical, offset, length)."""
    critical = rows.where("critical").select("extension_id", F.lit("critical").alias("rule"))
    twice = rows.groupBy("extension_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("extension_id", F.lit("duplicate").alias("rule"))
    outside = bad_ranges(rows, "offset", "length", F.lit(payload_len)).select("extension_id", F.lit("range").alias("rule"))
    return critical.unionByName(twice).unionByName(outside)


def bad_wrappers(rows: DataFrame, archives: DataFrame | None = None) -> DataFrame:
    """(slot, rule) of a stack of (slot, algorithm_id, algorithm_version): all slots, known algorithms, version 1.

    With ``archives`` (archive), of many stacks at once: (archive, slot, rule) of rows that have an archive each."""
    many = archives is not None
    owners = archives if many else rows.sparkSession.range(1).select(F.lit(0).alias("archive"))
    rows = rows if many else rows.withColumn("archive", F.lit(0))
    slots = F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(ALGORITHMS[s]).alias("wanted")) for s in WRAPPERS])
    known = owners.select("archive", F.inline(slots))
    both = known.join(rows, ["archive", "slot"], "full_outer")
    rule = (
        F.when(F.col("wanted").isNull(), "unknown slot")
        .when(F.col("algorithm_id").isNull(), "missing")
        .when((F.col("algorithm_id") != F.col("wanted")) & ~((F.col("slot") == "crypt") & (F.col("algorithm_id") == "aes-256-gcm")), "algorithm")
        .when(F.col("algorithm_version") != 1, "version")
    )
    return both.select(*(["archive"] if many else []), "slot", rule.alias("rule")).where("rule IS NOT NULL")


def bad_chunks(chunks: DataFrame) -> DataFrame:
    """(id, rule) of an index: ids and block_index unique, offsets the running sum, blocks not too long,
    raw blocks as long as their content."""
    checks = {
        "block too long": F.col("block_len") > MAX_BLOCK,
        "raw length": F.col("stored_raw") & (F.col("compressed_len") != F.col("plaintext_len")),
    }
    found = [chunks.where(c).select("id", F.lit(rule).alias("rule")) for rule, c in checks.items()]
    for column, rule in (("id", "duplicate id"), ("block_index", "duplicate index")):
        many = chunks.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(column)
        found.append(chunks.join(many, column, "left_semi").select("id", F.lit(rule).alias("rule")).distinct())
    from cairn.operators.catalog import reoffset

    again = reoffset(chunks.select("id", "block_index", "block_len").withColumn("data_offset", long(0)))
    moved = chunks.select("id", "block_index", "data_offset").join(again.select("id", "block_index", F.col("data_offset").alias("right")), ["id", "block_index"])
    found.append(moved.where("data_offset <> right").select("id", F.lit("offset").alias("rule")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def bad_tiling(windows: DataFrame) -> DataFrame:
    """(file, idx, rule): windows (file, idx, window_offset, window_len, total) that do not tile their file."""
    w = Window.partitionBy("file").orderBy("idx")
    due = F.lag(F.col("window_offset") + F.col("window_len"), 1, 0).over(w)
    last = F.lead("idx").over(w).isNull()
    rows = windows.withColumn("_due", due).withColumn("_last", last)
    gap = rows.where("window_offset <> _due").select("file", "idx", F.lit("gap").alias("rule"))
    short = rows.where(F.col("_last") & (F.col("window_offset") + F.col("window_len") != F.col("total"))).select("file", "idx", F.lit("end").alias("rule"))
    return gap.unionByName(short)


def bad_payload_lengths(rows: DataFrame) -> DataFrame:
    """Rows of (window_len, payload_len) whose payload is longer than parity at the highest overhead."""
    from cairn.functions import numbers

    k, p = numbers.grid(long(numbers.MOST_PCT))
    return rows.where(~F.coalesce((F.col("payload_len") >= 0) & (F.col("payload_len") <= numbers.payload_len(F.col("window_len"), k, p)), F.lit(False)))


def section(content: Column, offset: Column, length: Column, cap: int = MAX_BLOCK) -> Column:
    """A range of bytes; null if it does not lie inside the content, or is longer than ``cap``."""
    o, n = offset.cast(WIDE), length.cast(WIDE)
    inside = (o >= 0) & (n >= 0) & (n <= cap) & (o + n <= F.octet_length(content))
    return F.when(inside, F.substring(content, (offset + 1).cast("int"), length.cast("int")))


def prefixed(content: Column, offset: Column, cap: int = MAX_BLOCK) -> Column:
    """What follows a length of four bytes at an offset; null if it is cut off, or longer than ``cap``."""
    from cairn.functions.bytes import read_le

    at = section(content, offset, long(4))
    return section(content, offset + 4, read_le(at, 0, 4).cast("bigint"), cap)
