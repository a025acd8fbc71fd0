"""Ordered folds whose state is small: sorted partitions streamed through a step function."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def fold_sorted(
    df: DataFrame, keys: list[str], order: list[str], values: list[str], step: Callable[..., Iterable[tuple]], returns: str
) -> DataFrame:
    """Feed the rows of each key, in order, to `step(state, *values)`.

    `state` is a dict that starts empty for each key and lives through its rows.
    Each tuple that `step` gives becomes an output row after the keys.  Memory is
    one Arrow batch plus the state, however many rows a key has.
    """
    found = T.StructType([df.schema[k] for k in keys] + T.StructType.fromDDL(returns).fields)
    arrow = to_arrow_schema(found)
    k = len(keys)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, {}
        for batch in batches:
            out = []
            for row in zip(*[column.to_pylist() for column in batch.columns]):
                key = row[:k]
                if key != current:
                    current, state = key, {}
                out.extend(key + result for result in step(state, *row[k:]))
            columns = list(zip(*out)) if out else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    rest = [c for c in order if c not in values]
    placed = df.select(*keys, *values, *rest).repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.select(*keys, *values).mapInArrow(stream, found)
