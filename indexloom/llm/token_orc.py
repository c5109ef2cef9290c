"""Token ids in ORC: stripes with run-length-encoded integers, row indexes and Bloom filters.

Documents are range-partitioned by id, sorted, encoded and written one file per range, so
files in order hold ascending ids and each can be read by stripes on its own.  Every row
keeps its range's number and its offset within the range; the ranges' totals, read from the
small integer columns alone, turn that into a document's place in the whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from indexloom.llm.tokens import encoder, slices
from indexloom.llm.workers import python_map

#: Writer options: rows of an index entry, bytes of a stripe, and the filter on document ids.
OPTIONS = {"orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(64 << 20), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd"}
SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of every whole text, each document's followed by ``end_id``.

    Null text counts as empty (its row holds the end id alone); null ids come first;
    repeated rows are written each; an empty table writes an empty table.
    """
    spark = docs.sparkSession
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, start = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for b in batches:
            for lo, rows in slices(b.column(1)):
                ids, at = enc.encode_many(b.column(1).slice(lo, rows), end_id)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, rows), pa.array(np.full(rows, part, np.int32)), pa.array(start + at[:-1]), pa.array(np.diff(at)), lists], ["doc_id", "part", "start_in_part", "n_tokens", "ids"])
                start += len(ids)

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    ordered.transform(python_map, encode, SCHEMA).write.options(**OPTIONS).orc(path)


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows; with ``doc_ids`` only those, by stripe statistics, row indexes and Bloom filters."""
    df = spark.read.schema(SCHEMA).orc(path)
    return df.where(F.col("doc_id").isin(doc_ids)) if doc_ids is not None else df


def bases(stored: DataFrame) -> DataFrame:
    """part, base: ids in all ranges before; one row per range, from the integer columns alone."""
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    return sums.select("part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("base"))


def digest(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what was stored."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            at = ids.offsets.to_numpy() * 4
            data = memoryview(ids.values.cast(pa.int32()).buffers()[1] or b"")
            base = ids.values.offset * 4
            sums = [zlib.crc32(data[base + s : base + e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(at) // 4, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    sums = stored.select("doc_id", "part", "start_in_part", "ids").transform(python_map, crc, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return sums.join(bases(stored), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")
