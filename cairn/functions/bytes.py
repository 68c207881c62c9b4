"""Expressions over binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunk_id(data: Column, key: bytes = b"") -> Column:
    """The first 16 bytes of SHA-256 over key and bytes, in hexadecimal (in place of a keyed BLAKE3)."""
    return F.substring(F.sha2(F.concat(F.lit(key), data) if key else data, 256), 1, 32)


def block_hash(block: Column) -> Column:
    return F.sha2(block, 256)


def binding_id(content_sha256: Column, domain: str = "cairn-sidecar-v1") -> Column:
    """A domain-separated hash of a content hash in hexadecimal."""
    return F.sha2(F.concat(F.lit(domain.encode()), F.unhex(content_sha256)), 256)


def parse_sha256(text: Column) -> Column:
    """32 bytes from hexadecimal text; null if it is anything else."""
    data = F.try_to_binary(F.btrim(text), F.lit("hex"))
    return F.when((F.length(F.btrim(text)) == 64) & (F.octet_length(data) == 32), data)


def base64url(data: Column) -> Column:
    """Unpadded URL-safe base64."""
    return F.rtrim(F.translate(F.base64(data), "+/\r\n", "-_"), F.lit("="))


def read_le(data: Column, at: int, width: int) -> Column:
    """An unsigned little-endian number as decimal(20,0); null beyond the end."""
    turned = F.concat(*[F.hex(F.substring(data, at + i + 1, 1)) for i in reversed(range(width))])
    return F.when(F.octet_length(data) >= at + width, F.conv(turned, 16, 10).cast("decimal(20,0)"))


def write_le(value: Column, width: int = 8) -> Column:
    digits = F.lpad(F.conv(value.cast("string"), 10, 16), 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))]))


def block_aad(prefix: str, index: Column, id_: Column) -> Column:
    return F.concat(F.lit(prefix.encode()), write_le(index), F.unhex(id_))


def chunk_aad(id_: Column, domain: str = "cairn-chunk-v1") -> Column:
    """What binds an encrypted block to its chunk."""
    return F.concat(F.lit(domain.encode()), F.unhex(id_))


def hmac_sha512(key: bytes, message: Column) -> Column:
    """HMAC-SHA512 by two hashes; the pads are made on the driver and stand in the plan, as the key would."""
    import hashlib

    key = (hashlib.sha512(key).digest() if len(key) > 128 else key).ljust(128, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message), 512))), 512)


def majority(a: Column, b: Column, c: Column) -> Column:
    """Byte by byte the most frequent of three copies of one length; of three different the first."""
    at = F.sequence(F.lit(1), F.octet_length(a))
    voted = F.transform(at, lambda i: F.when(F.substring(b, i, F.lit(1)) == F.substring(c, i, F.lit(1)), F.hex(F.substring(b, i, F.lit(1)))).otherwise(F.hex(F.substring(a, i, F.lit(1)))))
    return F.when(F.octet_length(a) > 0, F.unhex(F.array_join(voted, ""))).otherwise(a)


def joined(data: str, order: str) -> Column:
    """An aggregate: binary values put together in order, as they are; null if there are none.  Nulls among them are left out: count them."""
    return F.expr(f"listagg({data}) WITHIN GROUP (ORDER BY {order})")
