"""Rows between Spark and Python functions: a few megabytes at a time, however many rows a batch has."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Bytes (about) of the rows that a task puts together before it hands them on, and what a row counts beside its bytes.
HANDED, ROW = 4 << 20, 128

_KINDS = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def schema(ddl: str) -> pa.Schema:
    """The Arrow schema of ``name kind, ...``."""
    return pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def handed(rows: Iterable[tuple], ddl: str) -> Iterator[pa.RecordBatch]:
    """Tuples as batches of about HANDED bytes; one row may be longer."""
    kinds, held, size = schema(ddl), [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*held), kinds.types)], schema=kinds)

    for row in rows:
        held.append(row)
        size += ROW + sum(len(x) for x in row if isinstance(x, bytes))
        if size >= HANDED:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def cells(batch: pa.RecordBatch) -> Iterator[tuple]:
    """A batch's rows, one after the other: binary values are copied when their row comes, not all at once."""
    plain = lambda c: c.to_pylist() if c.type != pa.binary() else (x.as_buffer().to_pybytes() if x.is_valid else None for x in c)
    return zip(*(plain(c) for c in batch.columns))
