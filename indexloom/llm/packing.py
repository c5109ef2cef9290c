"""Best-fit packing of documents into sequences of bounded length.

Lengths are integers up to the capacity, so what to pack is a histogram of at most
``capacity`` counts, whatever the size of the corpus.  The driver packs the histogram:
items above a third of the capacity are matched, at most two in a bin, the largest with
the largest partner that fits; smaller ones, from the largest, go to the tightest gaps.
The outcome is a list of intervals (length, ranks, bins, place), and each piece finds its
own by its rank among the pieces of its length.  Ranks come from two levels (within a
bucket, then over bucket totals), so one length may hold any part of the rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from indexloom.llm.scratch import Scratch, spread
from indexloom.llm.tokens import encoder, slices
from indexloom.llm.workers import python_map

CAPACITY = 4096


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """_row, doc_id, piece, start, length, ids_crc32 (and ids, little-endian, if asked for).

    A document is the ids of its whole text (null: none), then ``end_id``; one longer than
    the capacity is cut at multiples of it.  _row numbers the pieces of this run.
    """
    fields = "_row long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, row = encoder(vocabulary), TaskContext.get().partitionId() << 40
        for b in batches:
            for lo, rows in slices(b.column(1)):
                ids, at = enc.encode_many(b.column(1).slice(lo, rows), end_id)
                data, size = memoryview(ids.tobytes()), np.diff(at)
                count = -(-size // capacity)
                doc = np.repeat(np.arange(rows), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, size[doc] - start)
                places = [(4 * s, 4 * e) for s, e in zip((at[doc] + start).tolist(), (at[doc] + start + length).tolist(), strict=True)]
                cols = [pa.array(row + np.arange(len(doc))), b.column(0).slice(lo, rows).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(data[s:e]) for s, e in places], pa.int64())]
                cols += [pa.array([bytes(data[s:e]) for s, e in places], pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in fields.split(", ")])
                row += len(doc)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(python_map, cut, fields)


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Intervals (length, first rank, ranks, first bin, items in a bin, offset) that place every item.

    Item ``rank`` of an interval lies in bin ``first bin + (rank - first rank) // items``, at
    ``offset + length * ((rank - first rank) % items)``.
    """
    left = {n: c for n, c in counts.items() if c}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    used = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first bin, bins)
    sizes: list[int] = []  # heap-free sorted list of gaps
    bins = 0

    def put(n: int, first: int, m: int, each: int, offset: int) -> None:
        out.append((n, used[n], m * each, first, each, offset))
        used[n] += m * each
        left[n] -= m * each

    def free(gap: int, first: int, m: int) -> None:
        if gap and m:
            if not gaps.setdefault(gap, []):
                heapq.heappush(sizes, gap)
            gaps[gap].append((first, m))

    # items above a third: match the largest with the largest partner that fits
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((p for p in large if p <= capacity - n and left[p] > (p == n)), None)
            m = left[n] if mate is None else left[n] // 2 if mate == n else min(left[n], left[mate])
            first, bins = bins, bins + m
            put(n, first, m, 1, 0)
            if mate is not None:
                put(mate, first, m, 1, n)
            free(capacity - n - (mate or 0), first, m)

    # smaller ones, from the largest: the tightest gap that holds one
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            gap = min((g for g in gaps if g >= n and gaps[g]), default=None)
            if gap is None:
                each = capacity // n
                m = max(1, left[n] // each)
                first, bins, gap = bins, bins + m, capacity
            else:
                first, m = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
            each = min(gap // n, left[n])
            fill = min(m, left[n] // each)
            put(n, first, fill, each, capacity - gap)
            free(gap - each * n, first, fill)
            free(gap, first + fill, m - fill)
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (with _row, doc_id, piece, length) with sequence_id and offset.

    ``parts`` must be a stored table (it is read more than once); _row must be unique, and orders pieces with equal
    or null ids.  Its other columns stay.  An empty table gives an empty result.
    """
    spark = parts.sparkSession
    scratch = Scratch(spark)
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    plan = np.array(sorted(pack_histogram(counts, capacity)), np.int64).reshape(-1, 6)
    span = max(counts.values(), default=0) + 1
    keys = plan[:, 0] * span + plan[:, 1]  # (length, first rank) in one number
    shared = spark.sparkContext.broadcast((plan, keys, span))  # a function of the histogram, not of the rows

    buckets = spread(sum(counts.values()))
    rows = scratch.cut(parts.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets))).withColumn("_i", F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "_row"))), "ranked")
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = rows.join(base, ["length", "_b"]).withColumn("_rank", F.col("_base") + F.col("_i") - 1).drop("_b", "_i", "_base")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, keys, span = shared.value
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            at = np.searchsorted(keys, n * span + rank, "right") - 1
            _, low, _, first, each, offset = plan[at].T if len(plan) else np.zeros((6, 0), np.int64)
            k = rank - low
            cols = [c for name, c in zip(b.schema.names, b.columns, strict=True) if name != "_rank"]
            names = [name for name in b.schema.names if name != "_rank"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(first + k // each), pa.array(offset + n * (k % each))], [*names, "sequence_id", "offset"])

    kept = ranked.drop("_rank")
    fields = kept.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.transform(python_map, place, fields)


def best_fit(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every document; one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are pieces of the end id alone; null ids and repeated rows are documents of their own, in any
    order among equals; a very long text is cut at multiples of the capacity; an empty table gives an empty result; other
    columns are left out, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    parts = scratch.cut(pieces(docs, vocabulary, end_id, capacity, id_col, text_col), "pieces")
    return pack(parts, capacity).drop("_row")
