"""Keys: from passwords, from each other, and wrapped.

All of it happens on the driver, once an archive: scrypt (in place of Argon2id) makes a key from a password, HKDF-SHA256
makes keys for purposes from one, and the archive's own key is kept wrapped (RFC 3394, by the JVM's cipher), so that a new password wraps it
anew and touches no block."""

from __future__ import annotations

import hashlib
import hmac
import os

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from cairn.model import Damaged

#: Bytes of keys and salts.
KEY, SALT = 32, 32
#: Cost of scrypt: 128 * N * r bytes of memory.
COST = {"n": 1 << 15, "r": 8, "p": 1}
PURPOSES = ("master", "mac", "block", "outer", "name", "sidecar")


def new_salt() -> bytes:
    return os.urandom(SALT)


def new_key() -> bytes:
    return os.urandom(KEY)


def from_password(password: str, salt: bytes) -> bytes:
    """A key that takes time and memory to guess."""
    if not password:
        raise ValueError("an empty password protects nothing")
    return hashlib.scrypt(password.encode(), salt=salt, dklen=KEY, maxmem=1 << 28, **COST)


def expand(key: bytes, purpose: str, size: int = KEY) -> bytes:
    """HKDF-SHA256 expansion: keys for different purposes say nothing about each other."""
    if purpose not in PURPOSES:
        raise ValueError(f"{purpose} is none of {PURPOSES}")
    out, block, n = b"", b"", 0
    while len(out) < size:
        n += 1
        block = hmac.digest(key, block + f"cairn-{purpose}-v1".encode() + bytes([n]), "sha256")
        out += block
    return out[:size]


def _cipher(spark: SparkSession, mode: str, kek: bytes):
    jvm = spark.sparkContext._jvm
    cipher = jvm.javax.crypto.Cipher.getInstance("AESWrap")
    spec = jvm.javax.crypto.spec.SecretKeySpec(bytearray(kek), "AES")
    cipher.init(getattr(jvm.javax.crypto.Cipher, mode), spec)
    return jvm, cipher


def wrap(spark: SparkSession, kek: bytes, key: bytes) -> bytes:
    jvm, cipher = _cipher(spark, "WRAP_MODE", kek)
    return bytes(b & 0xFF for b in cipher.wrap(jvm.javax.crypto.spec.SecretKeySpec(bytearray(key), "AES")))


def unwrap(spark: SparkSession, kek: bytes, wrapped: bytes) -> bytes:
    """The key; an error if the kek is another, or the wrapped key was changed."""
    jvm, cipher = _cipher(spark, "UNWRAP_MODE", kek)
    try:
        key = cipher.unwrap(bytearray(wrapped), "AES", jvm.javax.crypto.Cipher.SECRET_KEY)
    except Py4JJavaError:
        raise Damaged("wrong password, or a damaged key") from None
    return bytes(b & 0xFF for b in key.getEncoded())


def seal(key: bytes, fields: dict[str, str]) -> str:
    """An HMAC-SHA512 over settings, names and lengths included."""
    body = b"".join(len(x).to_bytes(4, "little") + x for k, v in sorted(fields.items()) for x in (k.encode(), v.encode()))
    return hmac.digest(expand(key, "mac", 64), body, "sha512").hex()
