"""Options, schemas and errors of the archive model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

KIB, MIB = 1 << 10, 1 << 20

ENTRIES = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("size", T.LongType(), False),
    T.StructField("modified", T.StringType(), True),
    T.StructField("is_dir", T.BooleanType(), False),
    T.StructField("chunks", T.ArrayType(T.StringType()), False),
    T.StructField("pack_offset", T.LongType(), True),
])
CHUNKS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("block_index", T.LongType(), False),
    T.StructField("data_offset", T.LongType(), False),
    T.StructField("block_len", T.LongType(), False),
    T.StructField("plaintext_len", T.LongType(), False),
    T.StructField("compressed_len", T.LongType(), False),
    T.StructField("cipher_hash", T.StringType(), False),
    T.StructField("stored_raw", T.BooleanType(), False),
])

#: The most bytes of a block, a section's prefix, an archive's most entries, its depth.
MAX_BLOCK, PREFIX, MAX_ENTRIES, MAX_DEPTH = 64 * MIB, 8, 500_000, 100
#: Files below SMALL are packed, packs close at PACK_TARGET bytes.
SMALL, PACK_TARGET = 256 * KIB, 4 * MIB
#: Fixed value: bytes that parity protects at a time.
WINDOW = 64 * MIB


class ArchiveError(Exception):
    """Any failure of an archive operation."""


class InvalidPath(ArchiveError):
    """A path that may not be in an archive."""


class NotFound(ArchiveError):
    """No entry of that name."""


class Conflict(ArchiveError):
    """The target exists, an ancestor is a file, or the snapshot is stale."""


class Damaged(ArchiveError):
    """Stored bytes do not match their record."""


@dataclass(frozen=True)
class Bounds:
    """Smallest, average and largest size of content-defined chunks."""

    smallest: int = 256 * KIB
    average: int = MIB
    largest: int = 4 * MIB

    @classmethod
    def for_level(cls, level: int) -> Bounds:
        """Compression levels from 19 on cut larger chunks."""
        return cls(MIB, 4 * MIB, 16 * MIB) if level >= 19 else cls()

    def checked(self) -> Bounds:
        power = self.average > 0 and self.average & (self.average - 1) == 0
        if not (4096 <= self.smallest <= self.average <= self.largest <= 256 * MIB and power):
            raise ArchiveError(f"chunk bounds {self} are not allowed")
        return self


@dataclass(frozen=True)
class Options:
    """How an archive is made; ``bounds`` override those of the level."""

    level: int = 3
    bounds: Bounds | None = None
    plaintext: bool = True
    parity_pct: int | None = None
    placement: str = "none"  # none, embedded, sidecar or both

    def cdc(self) -> Bounds:
        return (self.bounds or Bounds.for_level(self.level)).checked()


#: What each wrapper of the stack is called, in order.
WRAPPERS = ["pack", "chunk", "id", "compress", "crypt", "index"]
ALGORITHMS = {"pack": "greedy-pack", "chunk": "gear-cdc", "id": "sha256-128", "compress": "zstd", "crypt": "none", "index": "json"}
