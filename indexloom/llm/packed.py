"""A packed exchange: hashes of a corpus shuffled as few large binary rows.

The map side hashes a chunk of documents at a time and packs, for each bucket, one row with
arrays; the reduce side sees all rows of a bucket together.  Per element that costs its
bytes and a sort in numpy instead of a row in every operator.  Buckets divide the hash
space, as many as the texts' stored size asks for; what a chunk repeats is packed once, so a
hash that a third of the corpus shares leaves each chunk once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indexloom.llm.scratch import Scratch
from indexloom.llm.workers import python_map

#: Bytes of text that the map side handles at a time, and of a chunk for each bucket at least.
CHUNK, ROW = 8 << 20, 4 << 10
#: Bytes of an exchange that a task reads, about, and bytes of an exchange for each byte of a stored table with the texts.
TASK, STRETCH = 128 << 20, 6
#: Buckets at most; tables above some 300 GB as stored make larger ones.
MOST = 1 << 14
#: An estimate from which on it is none (joins multiply estimates; rows from elsewhere have the largest number).
UNKNOWN = 1 << 50


@dataclass(frozen=True)
class Layout:
    """How an exchange is dealt: tasks, buckets of the hash space (some for every task), bytes of a chunk."""

    tasks: int
    buckets: int
    chunk: int


def _size(df: DataFrame) -> int:
    """Bytes by Spark's estimate: for columns of files, their size as stored."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def sized(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` themselves if Spark knows their size, as it does for tables of files; else as a written table."""
    return docs if _size(docs) < UNKNOWN else scratch.cut(docs, "docs")


def layout(stored: DataFrame) -> Layout:
    """For the texts of a written table, by its size as the files have it."""
    spark = stored.sparkSession
    size = _size(stored)
    tasks = min(MOST, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-STRETCH * size // TASK)))
    buckets = min(MOST, max(256, 4 * tasks))
    return Layout(tasks, buckets, max(CHUNK, ROW * buckets))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the high bits, so that a bucket is a range of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK) -> Iterator[dict[str, list]]:
    """Columns of consecutive rows with about ``size`` bytes of text together; texts as bytes."""
    held: dict[str, list] = {}
    weight = 0
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            for name in part.schema.names:
                col = part.column(name)
                held.setdefault(name, []).extend((col.cast(pa.binary()) if name == text else col).to_pylist())
            weight = sum(map(len, filter(None, held[text][-part.num_rows :]))) + weight
            if weight >= size:
                yield held
                held, weight = {}, 0
    if held and held[text]:
        yield held


def by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) of each bucket that occurs, positions ascending."""
    order = np.argsort(buckets, kind="stable")
    if len(order):
        cuts = np.flatnonzero(np.diff(buckets[order])) + 1
        for at in np.split(order, cuts):
            yield int(buckets[at[0]]), at


def reduce_buckets(packed: DataFrame, tasks: int, reduce: Callable[[list[dict]], Iterator[pa.RecordBatch] | list[pa.RecordBatch]], schema: str, key: str = "bucket") -> DataFrame:
    """Applies ``reduce`` to the rows of each bucket, all together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            for row in b.to_pylist():
                if held and row[key] != held[0][key]:
                    yield from reduce(held)
                    held = []
                held.append(row)
        if held:
            yield from reduce(held)

    return packed.repartition(tasks, F.col(key)).sortWithinPartitions(key).transform(python_map, run, schema)
