"""Arrow batches in and out of tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

_KINDS = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()),
}


def rows(schema: str, **columns) -> pa.RecordBatch:
    """A batch of a "name kind, ..." schema with the given columns; the others are null."""
    fields = [field.strip().rsplit(" ", 1) for field in schema.split(", ")]
    n = len(next(iter(columns.values())))
    arrays = [pa.array(columns[name], _KINDS[kind]) if name in columns else pa.nulls(n, _KINDS[kind]) for name, kind in fields]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def ids_and_texts(batches: Iterator[pa.RecordBatch], at_once: int = 256) -> Iterator[tuple[list, list[bytes | None]]]:
    """(values of the first column, UTF-8 of the second), some rows at a time."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
        for at in range(0, batch.num_rows, at_once):
            yield ids.slice(at, at_once).to_pylist(), texts.slice(at, at_once).to_pylist()
