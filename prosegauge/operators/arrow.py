"""Row-local Python functions as Columns that hold little at a time.

A batch that comes from the JVM is worked off in pieces of at most PIECE_BYTES and PIECE_ROWS, and each piece's results leave
before the next piece is read; so a worker's memory follows neither the table nor the session's batch size. What a task freed
goes back to the system when it ends, since workers are used again."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

PIECE_BYTES, PIECE_ROWS = 1 << 20, 512


@functools.cache
def _libc() -> Any:
    """The C library, if it can give freed memory back to the system."""
    try:
        libc = ctypes.CDLL(None)
        libc.malloc_trim(0)
        return libc
    except (OSError, AttributeError):
        return None


def give_back() -> None:
    """Memory that this process freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)


def piece_sizes(rows: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a batch of that many rows and bytes."""
    step = max(1, min(PIECE_ROWS, rows * PIECE_BYTES // max(1, size)))
    for at in range(0, rows, step):
        yield at, min(step, rows - at)


def by_row(one: Callable[..., Any], kind: str) -> Callable[..., Column]:
    """A function of Columns whose value in each row is one(values of the row). A struct comes as a tuple of its fields."""
    def made(values: list, result: pa.DataType) -> pa.Array:
        if not pa.types.is_struct(result):
            return pa.array(values, result)
        fields = zip(*values, strict=True) if values else [[] for _ in result]
        return pa.StructArray.from_arrays([pa.array(list(v), f.type) for v, f in zip(fields, result, strict=True)], fields=list(result))

    def worked(batches: Iterator[tuple[pa.Array, ...]], result: pa.DataType) -> Iterator[pa.Array]:
        try:
            for columns in batches:
                for at, n in piece_sizes(len(columns[0]), sum(c.nbytes for c in columns)):
                    yield made([one(*row) for row in zip(*(c.slice(at, n).to_pylist() for c in columns), strict=True)], result)
        finally:
            give_back()

    def column(*columns: Column | str) -> Column:
        result = to_arrow_type(T._parse_datatype_string(f"v {kind}")[0].dataType)

        def single(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from worked(((b,) for b in batches), result)

        def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            yield from worked(batches, result)

        single.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        several.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
        return F.arrow_udf(single if len(columns) == 1 else several, kind)(*columns)

    return column


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a mapInArrow in pieces of the same bounds."""
    try:
        for batch in batches:
            for at, n in piece_sizes(batch.num_rows, batch.nbytes):
                yield batch.slice(at, n)
    finally:
        give_back()
