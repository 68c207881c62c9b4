"""Integer arithmetic of sizes and error correction; all whole numbers, no ties of rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels of parity by name, in percent.
LEVELS = {"low": 7, "medium": 15, "quartile": 25, "high": 30}
LEAST_PCT, MOST_PCT, DEFAULT_PCT = 5, 50, 20
#: Bytes of a payload's header and of a checksum; least and most bytes of a shard.
HEADER, CHECKSUM, LEAST_SHARD, MOST_SHARD = 32, 16, 4 << 10, 1 << 20
#: Bytes of a sidecar without segments, of a segment's three locators.
SIDECAR, SEGMENT = 333, 168


def long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def div(a: Column, b) -> Column:
    b = long(b) if isinstance(b, int) else b
    return F.call_function("div", a, b)


def ceil_div(a: Column, b) -> Column:
    b = long(b) if isinstance(b, int) else b
    return div(a + b - 1, b)


def clamp_pct(pct: Column) -> Column:
    return F.least(F.greatest(pct, long(LEAST_PCT)), long(MOST_PCT))


def level_pct(level: Column) -> Column:
    """A level's name or a number with or without ``%``; null for anything else."""
    text = F.lower(F.btrim(level))
    out = F.when(text == "low", LEVELS["low"])
    for name, pct in LEVELS.items():
        out = out.when(text == name, pct)
    number = F.rtrim(text, F.lit("%")).try_cast("bigint")
    return out.when(number.isNotNull(), clamp_pct(number)).cast("bigint")


def grid(pct: Column) -> tuple[Column, Column]:
    """(data shards K, parity shards P) of a group at this overhead; null: the default."""
    pct = clamp_pct(F.coalesce(pct, long(DEFAULT_PCT)))
    p = F.when(pct < 10, long(1)).otherwise(long(2))
    return F.greatest(long(2), div(p * 100 + div(pct, 2), pct)), p


def geometry(length: Column, k: Column) -> dict[str, Column]:
    """Shard size, data shards and groups for that many protected bytes."""
    shard = F.least(F.greatest(ceil_div(length, k), long(LEAST_SHARD)), long(MOST_SHARD))
    shards = ceil_div(length, shard)
    return {"shard": shard, "shards": shards, "groups": ceil_div(shards, k)}


def payload_len(length: Column, k: Column, p: Column) -> Column:
    """Bytes of the parity payload of a window; none for no bytes."""
    g = geometry(length, k)
    return F.when(length == 0, long(0)).otherwise(HEADER + CHECKSUM * (g["shards"] + p * g["groups"]) + p * g["groups"] * g["shard"])


def windows(length: Column, window: int) -> Column:
    """Array of (idx, window_offset, window_len) that tile ``length`` bytes; one empty window for none."""
    n = F.greatest(ceil_div(length, window), long(1))
    return F.transform(
        F.sequence(long(0), n - 1),
        lambda i: F.struct(i.alias("idx"), (i * window).alias("window_offset"), F.least(long(window), length - i * window).alias("window_len")),
    )


def sidecar_len(length: Column, pct: Column, window: int) -> Column:
    """Bytes of the sidecar of a file, by a closed form."""
    k, p = grid(pct)
    n = F.greatest(ceil_div(length, window), long(1))
    last = length - (n - 1) * window
    return SIDECAR + n * SEGMENT + (n - 1) * payload_len(long(window), k, p) + payload_len(last, k, p)


UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]


def format_size(size: Column) -> Column:
    """1024-based with one decimal, rounded half up by whole numbers."""
    out = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for i, unit in enumerate(UNITS[1:], 1):
        tenths = div(size * 10 + (1 << (10 * i - 1)), 1 << (10 * i))
        text = F.concat(div(tenths, 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = out.when(size < (1 << 10 * (i + 1)), text) if unit != UNITS[-1] else out.otherwise(text)
    return out
