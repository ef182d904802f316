"""Input tables and Arrow helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step takes at once; bounds a Python worker's memory, not the result.
PIECE_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that the column has about limit bytes in each; a longer text stands alone."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
        first = 0
        while first < n:
            done = size[first - 1] if first else 0
            last = max(int(size.searchsorted(done + limit, "right")), first + 1)
            yield batch.slice(first, last - first)
            first = last


def map_arrow(df: DataFrame, column: str, one: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, limit: int = PIECE_BYTES) -> DataFrame:
    """df through one, batch by batch; None gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, column, limit):
            if (out := one(piece)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)
