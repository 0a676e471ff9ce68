"""What the training-data operators share: tables, reliable checkpoints, free column names and row-local Arrow passes."""

from __future__ import annotations

import ctypes
import functools
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import read, shared_folder

#: Bytes of an Arrow batch that goes to a Python worker, where the session leaves Spark's default of 64 MB and more.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, sf_dir, name)


def checkpointed(df: DataFrame, scanned: bool = False) -> DataFrame:
    """Cut the lineage through the shared folder, in at most three files a core: many small partitions would each be a file, and
    creating files is what small checkpoints cost. A table that comes straight from a scan keeps the scan's splits."""
    shared_folder(df.sparkSession)
    few = df if scanned else df.coalesce(3 * df.sparkSession.sparkContext.defaultParallelism)
    return few.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python workers, unless the session bounds them below 1 MB itself."""
    if re.fullmatch(r"\d{1,6}b?", spark.conf.get(_BATCH_CONF).lower()) is None:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


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
    """Memory that this process freed goes back to the system, as after a model was fitted in the driver."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)


def lean(run: Callable[..., Any]) -> Callable[..., Any]:
    """run over batches for a Python worker that serves many tasks: what one task freed does not stay with the worker."""

    def over_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return over_batches


def lean_group(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """The same for one group, or a pair of cogroups; small groups follow one another too fast to be worth it."""

    def over_one(a: pa.Table) -> pa.Table:
        out = run(a)
        if a.nbytes > 1 << 19:
            give_back()
        return out

    def over_two(a: pa.Table, b: pa.Table) -> pa.Table:
        out = run(a, b)
        if a.nbytes + b.nbytes > 1 << 19:
            give_back()
        return out

    return over_two if run.__code__.co_argcount == 2 else over_one


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df less its own columns of these names, in any case: results take their place."""
    gone = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in gone])


def text_slices(column: pa.Array, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most max_bytes of text each, or of a single longer row: whole texts in bounded memory."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > max_bytes:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def arrow_columns(
    df: DataFrame,
    text_col: str,
    added: list[tuple[str, str]],
    compute: Callable[[pa.Array], list[pa.Array]],
    max_bytes: int = 4 << 20,
) -> DataFrame:
    """df with columns computed from text_col, slice by slice, in one pass without a shuffle.

    compute gets a string array (nulls kept) and returns one array for each added (name, type). df's own columns of the
    added names go, in any case, so that every result can be read."""
    df = without(df, [n for n, _ in added])
    schema = T.StructType(df.schema.fields + [T.StructField(n, T._parse_datatype_string(t)) for n, t in added])
    at = df.columns.index(text_col)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch.column(at), max_bytes):
                part = batch.slice(i, j - i)
                extra = compute(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*part.schema.names, *(n for n, _ in added)])

    return df.mapInArrow(lean(run), schema)


def hash_drawn(rows: DataFrame, share: Column) -> DataFrame:
    """The distinct rows whose hash falls under their share: a filter, so that no task or driver gathers more than it keeps, and
    the same rows in whatever order they come. Rows that are repeated, however often, are drawn together and count once."""
    place = F.pmod(F.xxhash64(*rows.columns, F.lit("drawn")), F.lit(1 << 30))
    kept = rows.where(place < share * (1 << 30)).select(place.alias("place_"), F.struct(*rows.columns).alias("row_"))
    return kept.groupBy("place_").agg(F.min("row_").alias("row_")).select("row_.*")


def drawn(rows: DataFrame, size: int) -> DataFrame:
    """About size distinct rows by their hash, all if there are fewer. Needs the count of rows."""
    total = rows.count()
    return hash_drawn(rows, F.lit(min(1.0, size / total) if total else 1.0))


def crc32_of_id(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary"))
