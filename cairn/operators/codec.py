"""Blocks from chunks and back: compression where it pays, and encryption by expressions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.batches import cells, handed
from cairn.model import MAX_BLOCK, MIB

#: A sample that zstd level 3 leaves at 97 % or more does not compress; sizes of the sample.
PROBE_LEVEL, PROBE_PCT, PROBE_WHOLE, PROBE_PARTS, PROBE_PART = 3, 97, MIB, 16, 64 << 10


@cache
def _zstd():
    """(compress(data, level), decompress(data, most)); an error where zstandard is missing, since no other codec could be told apart later.

    A process makes its contexts once."""
    import zstandard

    compressor, decompressor = cache(lambda level: zstandard.ZstdCompressor(level=level)), zstandard.ZstdDecompressor()

    def unpack(data: bytes, most: int) -> bytes:
        with decompressor.stream_reader(data) as r:
            return r.read(most + 1)

    return lambda data, level: compressor(level).compress(data), unpack


def sample(chunk: bytes) -> bytes:
    """The chunk, or evenly spread parts of a long one."""
    if len(chunk) <= PROBE_WHOLE:
        return chunk
    step = (len(chunk) - PROBE_PART) // (PROBE_PARTS - 1)
    return b"".join(chunk[i * step : i * step + PROBE_PART] for i in range(PROBE_PARTS))


def is_incompressible(chunk: bytes) -> bool:
    if not chunk:
        return False
    some = sample(chunk)
    return len(_zstd()[0](some, PROBE_LEVEL)) * 100 >= len(some) * PROBE_PCT


BLOCKS = "id string, plaintext_len bigint, compressed_len bigint, stored_raw boolean, block binary"


def packed(chunk: bytes, level: int) -> tuple[bytes, bool]:
    """(block, whether it is the chunk as it was)."""
    some, pack = sample(chunk), _zstd()[0]
    probe = pack(some, PROBE_LEVEL)
    if chunk and len(probe) * 100 >= len(some) * PROBE_PCT:
        return chunk, True
    out = probe if level == PROBE_LEVEL and len(some) == len(chunk) else pack(chunk, level)
    return (chunk, True) if len(out) >= len(chunk) else (out, False)


def compressed(chunks: DataFrame, level: int = 3) -> DataFrame:
    """Blocks of (id, data): compressed, or raw if the probe or the result says that it does not pay."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for id_, data in (row for b in batches for row in cells(b)):
            block, raw = packed(data, level)
            yield id_, len(data), len(block), raw, block

    return chunks.select("id", "data").mapInArrow(lambda batches: handed(blocks(batches), BLOCKS), BLOCKS)


PLAIN = "id string, data binary"


def decompressed(blocks: DataFrame) -> DataFrame:
    """(id, data): blocks unpacked, never beyond their recorded length; data is null if the block is missing or wrong."""

    def one(data: bytes | None, n: int | None, raw: bool | None) -> bytes | None:
        import zstandard

        if data is None or n is None or n > MAX_BLOCK:
            return None
        try:
            got = data if raw else _zstd()[1](data, n)
        except zstandard.ZstdError:
            return None
        return got if len(got) == n else None

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for id_, *block in (row for b in batches for row in cells(b)):
            yield id_, one(*block)

    return blocks.select("id", "block", "plaintext_len", "stored_raw").mapInArrow(lambda batches: handed(plain(batches), PLAIN), PLAIN)


def encrypted(block: Column, key: Column, iv: Column, aad: Column) -> Column:
    """AES-GCM: 12 bytes of iv, ciphertext, tag.  Not resistant to a repeated iv: never use one twice
    under a key.  A key in a plan can be read there; derive it where the session is private."""
    return F.aes_encrypt(block, key, F.lit("GCM"), F.lit("DEFAULT"), iv, aad)


def decrypted(block: Column, key: Column, aad: Column) -> Column:
    """Null if the block, the key or the aad is not what it was."""
    return F.try_aes_decrypt(block, key, F.lit("GCM"), F.lit("DEFAULT"), aad)


def name_token(key: bytes, name: Column) -> Column:
    """A deterministic token that stands for a name, equal for equal names."""
    from cairn.functions.bytes import hmac_sha512

    return F.substring(hmac_sha512(key, F.encode(name, "UTF-8")), 1, 64)


def cascaded(block: Column, inner: Column, outer: Column, aad: Column) -> Column:
    """Two layers of AES-GCM under independent keys, each with an iv of its own at random."""
    return F.aes_encrypt(F.aes_encrypt(block, inner, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), aad), outer, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), aad)


def uncascaded(block: Column, inner: Column, outer: Column, aad: Column) -> Column:
    """Null if either layer fails."""
    return decrypted(decrypted(block, outer, aad), inner, aad)


def hidden_name(key: bytes, name: Column) -> Column:
    """A name encrypted under an iv made from itself, as URL-safe text: equal names look equal, and can be read back."""
    from cairn.functions.bytes import base64url, hmac_sha512

    data = F.encode(name, "UTF-8")
    iv = F.unhex(F.substring(hmac_sha512(b"name" + key, data), 1, 24))
    return base64url(F.aes_encrypt(data, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), iv))


def shown_name(key: bytes, token: Column) -> Column:
    """The name; null if the token is not of this key, or was changed."""
    raw = F.try_to_binary(F.translate(token, "-_", "+/"), F.lit("base64"))
    return F.decode(F.try_aes_decrypt(raw, F.lit(key), F.lit("GCM")), "UTF-8")
