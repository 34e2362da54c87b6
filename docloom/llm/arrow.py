"""Running Python over text columns in Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def per_batch(df: DataFrame, work: Callable[..., dict[str, pa.Array]], schema: str, rows: int = 1024) -> DataFrame:
    """``work`` gets a dict of Python lists, one per column, and returns Arrow arrays by output column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows):
            out = work({n: b.column(n).to_pylist() for n in b.schema.names})
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return df.mapInArrow(run, schema)
