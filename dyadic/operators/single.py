"""Finishes what is left of a distributed loop in one task, once it is small: a bounded number of rows, never a whole table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from dyadic.session import ship_package

#: Rows that one task may finish; a loop hands over only after it has counted no more.
FEW_ROWS = 1 << 15


def _gather(work: Callable[[pa.Table], pa.RecordBatch], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        yield work(pa.Table.from_batches(held))


def in_one_task(df: DataFrame, work: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """What work makes of all rows of df, of which there must be no more than FEW_ROWS."""
    ship_package(df.sparkSession)
    return df.coalesce(1).mapInArrow(partial(_gather, work), schema)
