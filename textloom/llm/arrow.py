"""Arrow plumbing shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SLICE_BYTES, OUT_ROWS = 1 << 20, 8192  # input turned into Python values at a time, rows of an output batch


def row_bytes(column: pa.Array) -> np.ndarray:
    """Size of every value of a column; nested values count with what they hold."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        ends = np.concatenate(([0], np.cumsum(row_bytes(column.values))))
        at = column.offsets.to_numpy()
        return 8 + ends[at[1:]] - ends[at[:-1]]
    if pa.types.is_map(kind):
        return np.full(len(column), 64, dtype=np.int64)
    if pa.types.is_struct(kind):
        return sum((row_bytes(x) for x in column.flatten()), np.zeros(len(column), dtype=np.int64))
    return np.full(len(column), 8, dtype=np.int64)


def by_bytes(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``most`` bytes and one row more."""
    if not batch.num_rows:
        return
    sizes = sum((row_bytes(c) for c in batch.columns), np.zeros(batch.num_rows, dtype=np.int64))
    group = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str, whole_batch: bool = False) -> DataFrame:
    """Apply a Python function to rows.

    ``make()`` runs once a task and gives ``f(*row) -> rows``, or with ``whole_batch`` ``f(*columns) -> rows``
    over lists.  A batch is turned into Python values ``SLICE_BYTES`` at a time and results leave every
    ``OUT_ROWS`` rows, so memory is bounded by bytes and not by the number of rows of a batch.
    """
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for part in by_bytes(batch):
                    columns = [c.to_pylist() for c in part.columns]
                    if whole_batch:
                        yield from f(*columns)
                    else:
                        for row in zip(*columns):
                            yield from f(*row)

        made = rows()
        while out := list(islice(made, OUT_ROWS)):
            arrays = [pa.array(col, type=field.type) for col, field in zip(zip(*out), target)]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)
