"""Expressions over archive paths: ``/`` between parts, none at either end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def join(parent: Column, name: Column) -> Column:
    return F.concat_ws("/", F.nullif(parent, F.lit("")), name)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Before the last ``/``; null for a path of one part."""
    return F.nullif(F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1), F.lit(""))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/", -1))


def ancestors(path: Column) -> Column:
    """All proper ancestors, shortest first."""
    parts = F.split(path, "/", -1)
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def is_descendant(path: Column, above: Column) -> Column:
    return F.startswith(path, F.concat(above, F.lit("/")))


def remap(path: Column, old: str, new: str) -> Column:
    """A path at or under ``old``, moved to ``new``."""
    return F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))


def is_valid(path: Column) -> Column:
    """Whether a path may be stored: relative, no ``..`` part, no NUL, backslash or drive."""
    bad = (
        (path == "")
        | F.startswith(path, F.lit("/"))
        | F.contains(path, F.lit("\\"))
        | F.contains(path, F.lit("\0"))
        | F.array_contains(F.split(path, "/", -1), "..")
        | (F.substring(path, 2, 1) == ":")
    )
    return F.coalesce(~bad, F.lit(False))


def normalized(path: Column) -> Column:
    """Trimmed of blanks and outer slashes; null if that is no valid path or has an empty or ``.`` part."""
    cut = F.btrim(F.btrim(path), F.lit("/"))
    parts = F.split(cut, "/", -1)
    return F.when(is_valid(cut) & ~F.array_contains(parts, "") & ~F.array_contains(parts, "."), cut)


def is_leaf_name(name: Column) -> Column:
    """One part, without ``..`` anywhere."""
    return is_valid(name) & ~F.contains(name, F.lit("/")) & ~F.contains(name, F.lit("..")) & (name != ".")
