"""Small helpers of the text operators: tables, Arrow batches, state kept by a Python worker."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: What separates words, for Java and Python patterns alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, make: Callable[[], Callable], ddl: str | T.StructType, finish: bool = False) -> DataFrame:
    """Pass the Arrow batches of each task through the function that `make()` gives, once per task; `ddl` is the result's schema.

    That function maps a batch to lists of columns, one list for each batch to
    put out.  With `finish` it is called a last time with None.
    """
    found = ddl if isinstance(ddl, T.StructType) else T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(found)

    def record(columns):
        cells = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, arrow)]
        return pa.RecordBatch.from_arrays(cells, schema=arrow)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for columns in step(batch):
                yield record(columns)
        if finish:
            for columns in step(None):
                yield record(columns)

    return df.mapInArrow(stream, found)


def kept_by_worker(key: tuple, build: Callable):
    """What `build()` gives, built once per Python worker while it works on tasks of this key.

    Functions travel to the workers by value, so a module's own globals would
    not outlive a task; the interpreter's do.  A worker keeps one such thing:
    the next stage's takes its place.
    """
    state = sys.__dict__.setdefault("_chirrup_kept", {})
    if key not in state:
        state.clear()
        state[key] = build()
    return state[key]


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024):
    """Arrow batches of few rows for the jobs that run inside: rows with long lists make batches large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row's begin and end; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def byte_sizes(column: pa.Array) -> list[int]:
    return np.diff(utf8(column)[1]).tolist()


def slices(sizes, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of consecutive rows of about `limit` bytes, one row at least."""
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def packed(df: DataFrame, **named: Column) -> DataFrame:
    """The rows of `df` as one struct `row`, beside the named columns, so that no column's name can meet another's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(k) for k, c in named.items()])


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def unused(df: DataFrame, name: str) -> str:
    """`name`, made longer until no column of `df` has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Regroup sorted batches so that no group, by the first `keys` columns, is cut; several groups per table.

    Holds one batch and the group that crosses into the next.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = group_starts(batch, keys)
        first, last = 0, int(starts[-1])
        if held and not all(held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        elif held and last:
            first = int(starts[1])
            yield pa.Table.from_batches([*held, batch.slice(0, first)])
            held = []
        if last > first:
            yield pa.Table.from_batches([batch.slice(first, last - first)])
        held.append(batch.slice(max(last, first) if not held else 0))
    if held:
        yield pa.Table.from_batches(held)


def group_starts(rows, keys: int) -> np.ndarray:
    """Where groups begin in sorted rows."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for k in range(keys):
        column = rows.column(k)
        values = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).to_numpy(zero_copy_only=False)
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def map_groups(df: DataFrame, keys: list[str], make: Callable[[], Callable], ddl: str, parts: int | None = None) -> DataFrame:
    """Pass every group of equal keys, whole, through the function that `make()` gives; it may get several groups in one call.

    The function gets a table sorted by the keys, which come first, and the
    places where groups begin, and gives lists of columns.  The caller bounds
    the groups.
    """
    found = T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(found)
    n = len(keys)

    def stream(batches):
        step = make()
        for rows in whole_groups(batches, n):
            for columns in step(rows.combine_chunks(), group_starts(rows, n)):
                cells = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)]
                yield pa.RecordBatch.from_arrays(cells, schema=arrow)

    rest = [c for c in df.columns if c not in keys]
    placed = df.select(*keys, *rest)
    placed = placed.repartition(parts, *keys) if parts else placed.repartition(*keys)
    return placed.sortWithinPartitions(*keys).mapInArrow(stream, found)
