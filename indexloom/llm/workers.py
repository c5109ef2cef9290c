"""Python workers that give memory back.

Executors keep their Python workers between tasks, and allocators keep what large batches took.
Operators map batches through ``python_map``, which returns free memory to the system after each task, so
what a worker holds between tasks is its bounded tables alone.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return  # another C library


def python_map(df: DataFrame, run: Mapper, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in workers that give memory back."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(lean, schema)
