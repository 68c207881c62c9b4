"""Text for people and settings: what things are called and how they are shown."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.numbers import format_size
from cairn.model import ALGORITHMS, WRAPPERS

#: Where parity may be kept.
PLACEMENTS = ["none", "embedded", "sidecar", "both"]
TIME = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def placement(text: Column) -> Column:
    """One of PLACEMENTS, whatever the case and blanks; null for anything else."""
    name = F.lower(F.btrim(text))
    return F.when(name.isin(PLACEMENTS), name)


def embeds(name: Column) -> Column:
    return F.coalesce(name.isin("embedded", "both"), F.lit(False))


def writes_sidecar(name: Column) -> Column:
    return F.coalesce(name.isin("sidecar", "both"), F.lit(False))


def algorithm_chain(algorithms: dict[str, str] | None = None, version: int = 1) -> list[str]:
    """``slot:algorithm vN`` of each wrapper in order."""
    known = ALGORITHMS | (algorithms or {})
    return [f"{slot}:{known[slot]} v{version}" for slot in WRAPPERS]


def size_cell(size: Column, is_dir: Column) -> Column:
    """A size for a listing; a dash for a directory."""
    return F.when(is_dir, "-").otherwise(format_size(size))


def capitalized(text: Column) -> Column:
    """The first letter large, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def as_time(at: Column) -> Column:
    """A timestamp as UTC text to the second."""
    return F.date_format(at, TIME)


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def as_json(rows: DataFrame) -> DataFrame:
    """(json): each row as a JSON object, columns in order."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def print_json(rows: DataFrame) -> None:
    """Print rows as JSON lines as they come, a partition at a time."""
    for r in as_json(rows).toLocalIterator():
        print(json.dumps(json.loads(r["json"]), ensure_ascii=False))
