"""Substring dedup by seed and extend.

Each document's 12-word runs are winnowed: of every 9 consecutive ones the smallest hash is
an anchor, so a match of 20 words holds the same anchor in both places.  Documents meet on
anchors that occur more than once; around those, and only there, matches are extended both
ways: an anchor's windows are the 20-word runs that chose it, up to 8 words to either side,
and a window that also starts earlier (smaller doc_id, or same document and earlier start)
marks its words.  Marks of neighbouring anchors join into maximal repeats, whose words go.

Every 20-word window chooses exactly one anchor, by content alone, so equal windows meet in
one anchor's bucket: nothing is missed.  Windows are compared by 128 bits.  Anchors (one in five words) are shuffled for all
documents as packed hashes; texts once, to the documents with repeated anchors; windows only
around these.  A chunk of documents sends each anchor and window once, with its first place,
so what a third of the corpus shares does not gather in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indexloom.llm.packed import bucket_of, by_bucket, chunks, layout, reduce_buckets
from indexloom.llm.scratch import Scratch, by_key, number
from indexloom.llm.text import Words, mix
from indexloom.llm.workers import python_map

#: Words of a window and of an anchor.
SPAN, SEED = 20, 12
_NULL = np.iinfo(np.int64).max


def chosen(w: Words, span: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the seed-word runs, and for each window's start the start of its anchor (the last smallest)."""
    runs = w.runs(seed)
    m, width = w.n - span + 1, span - seed + 1
    if m <= 0:
        return runs, np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(runs, width)[:, ::-1]
    return runs, np.arange(m) + width - 1 - np.argmin(view, axis=1)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _packed(rows: list[tuple], fields: str) -> pa.RecordBatch:
    """Rows as a batch with the columns of a DDL string."""
    names, kinds = zip(*(f.split() for f in fields.split(", ")), strict=True)
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(cols, kinds, strict=True)], list(names))


def repeats(docs: DataFrame, scratch: Scratch, span: int = SPAN, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """``docs`` has _uid, doc_id, text.  Returns the documents with a repeated anchor (_uid, doc_id,
    text) and their marks: _uid, mark (start * 256 + windows), windows that start earlier elsewhere."""
    dealt = layout(docs)
    buckets = dealt.buckets

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, size=dealt.chunk):
            hs, uid = [], []
            for u, t in zip(c["_uid"], c["text"], strict=True):
                runs, at = chosen(Words(t), span, seed)
                if len(at):
                    own = np.unique(at)
                    hs.append(runs[own])
                    uid.append(np.full(len(own), u, np.int64))
            if not hs:
                continue
            h, u = np.concatenate(hs), np.concatenate(uid)
            order = np.argsort(h, kind="stable")
            h, u = h[order], u[order]
            new = np.concatenate(([True], h[1:] != h[:-1]))
            ends = np.append(np.flatnonzero(new)[1:], len(h))
            many = np.zeros(len(h), bool)
            many[new] = ends - np.flatnonzero(new) > 1
            again = np.flatnonzero(many[np.flatnonzero(new)][np.cumsum(new) - 1])
            one = np.flatnonzero(new)
            rows = [(b, h[one[at]].tobytes(), np.where(many[one[at]], -1, u[one[at]]).tobytes(), b"") for b, at in by_bucket(bucket_of(h[one], buckets))]
            # an anchor that occurs more than once here repeats for certain: its documents are dealt out by their own numbers
            rows += [(b, b"", b"", np.column_stack((u[again[at]], h[again[at]].view(np.int64))).tobytes()) for b, at in by_bucket(bucket_of(mix(u[again].view(np.uint64)), buckets))]
            yield _packed(rows, "bucket int, hashes binary, first binary, known binary")

    def meet(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows])
        u = np.concatenate([np.frombuffer(r["first"], np.int64) for r in rows])
        order = np.argsort(h, kind="stable")
        h, u = h[order], u[order]
        same = h[1:] == h[:-1]
        twice = np.zeros(len(h), bool)
        twice[1:] |= same
        twice[:-1] |= same
        twice &= u >= 0
        pairs = np.concatenate([np.frombuffer(r["known"], np.int64).reshape(-1, 2) for r in rows] + [np.column_stack((u[twice], h[twice].view(np.int64)))])
        for lo in range(0, len(pairs), 1 << 16):
            part = pairs[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], ["_uid", "anchor"])

    packed = docs.select("_uid", "text").transform(python_map, anchors, "bucket int, hashes binary, first binary, known binary")
    seeds = reduce_buckets(packed, dealt.tasks, meet, "_uid long, anchor long").groupBy("_uid").agg(F.collect_set("anchor").alias("anchors"))
    there = scratch.cut(docs.join(by_key(seeds), "_uid"), "seeded")
    del packed, seeds
    scratch.release()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, size=dealt.chunk):
            # by doc_id, so that the first of equal windows of the chunk is the earliest
            order = sorted(range(len(c["_uid"])), key=lambda i: (_NULL if c["doc_id"][i] is None else c["doc_id"][i], c["_uid"][i]))
            hs, gs, docs_at, starts, keys = [], [], [], [], []
            for n, i in enumerate(order):
                w = Words(c["text"][i])
                runs, at = chosen(w, span, seed)
                if not len(at):
                    continue
                known = np.sort(np.array(c["anchors"][i], np.int64).view(np.uint64))
                key = runs[at]
                put = np.searchsorted(known, key)
                here = np.flatnonzero(known[np.minimum(put, len(known) - 1)] == key)
                if len(here):
                    hs.append(w.runs(span)[here])
                    gs.append(w.runs(span, again=True)[here])
                    keys.append(key[here])
                    starts.append(here)
                    docs_at.append(np.full(len(here), n, np.int64))
            if not hs:
                continue
            h, g, key, start, doc = map(np.concatenate, (hs, gs, keys, starts, docs_at))
            uid = np.array([c["_uid"][i] for i in order], np.int64)
            rank = np.array([_NULL if c["doc_id"][i] is None else c["doc_id"][i] for i in order], np.int64)
            order2 = np.lexsort((g, h))
            new = np.ones(len(h), bool)
            new[order2[1:]] = (h[order2[1:]] != h[order2[:-1]]) | (g[order2[1:]] != g[order2[:-1]])
            first, later = np.flatnonzero(new), np.flatnonzero(~new)
            both = np.column_stack((h, g))
            rows = []
            for b, at in by_bucket(bucket_of(key[first], buckets)):
                own = first[at]  # in order of (doc, start), so that an anchor's windows are a run
                lead, mark = _spans(doc[own], start[own])
                at0 = doc[own[lead]]
                rows.append((b, both[own].tobytes(), np.column_stack((rank[at0], uid[at0], mark)).tobytes(), b""))
            rows += [(b, b"", b"", _runs(uid[doc[later[at]]], start[later[at]]).tobytes()) for b, at in by_bucket(bucket_of(mix(uid[doc[later]].view(np.uint64)), buckets))]
            yield _packed(rows, "bucket int, hashes binary, place binary, marks binary")

    def extend(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([np.frombuffer(r["hashes"], np.uint64).reshape(-1, 2) for r in rows])
        place = _unrolled(np.concatenate([np.frombuffer(r["place"], np.int64).reshape(-1, 3) for r in rows]))
        order = np.lexsort((place[:, 2], place[:, 1], place[:, 0], h[:, 1], h[:, 0]))
        h, place = h[order], place[order]
        later = np.zeros(len(h), bool)
        later[1:] = (h[1:] == h[:-1]).all(axis=1)
        found = place[later]
        found = found[np.lexsort((found[:, 2], found[:, 1]))]
        marks = np.concatenate([np.frombuffer(r["marks"], np.int64).reshape(-1, 2) for r in rows] + [_runs(found[:, 1], found[:, 2])])
        for lo in range(0, len(marks), 1 << 16):
            part = marks[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], ["_uid", "mark"])

    spans = there.transform(python_map, windows, "bucket int, hashes binary, place binary, marks binary")
    marks = scratch.cut(reduce_buckets(spans, dealt.tasks, extend, "_uid long, mark long"), "marks")
    return there, marks


def _spans(uid: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of a row of it, start * 256 + windows) of runs of consecutive starts; the input is in order of (uid, start)."""
    if not len(uid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero((uid[1:] != uid[:-1]) | (start[1:] != start[:-1] + 1)) + 1
    lo = np.concatenate(([0], cut))
    n = np.diff(np.concatenate((lo, [len(uid)])))
    first = start[lo]
    # at most 255 windows in a mark
    parts = np.maximum(1, -(-n // 255))
    at = np.repeat(np.arange(len(lo)), parts)
    k = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
    return lo[at], (first[at] + 255 * k) * 256 + np.minimum(255, n[at] - 255 * k)


def _runs(uid: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(uid, start * 256 + windows) of runs of consecutive starts; the input is in order of (uid, start)."""
    at, mark = _spans(uid, start)
    return np.column_stack((uid[at], mark))


def _unrolled(runs: np.ndarray) -> np.ndarray:
    """(rank, uid, start) of each window of runs (rank, uid, start * 256 + windows)."""
    n = runs[:, 2] & 255
    at = np.repeat(np.arange(len(runs)), n)
    step = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return np.column_stack((runs[at, 0], runs[at, 1], (runs[at, 2] >> 8) + step))


def covered(words: int, marks: list[int], span: int = SPAN) -> np.ndarray:
    """Which words lie in a marked window."""
    m = np.array(marks, np.int64)
    start, n = m >> 8, m & 255
    edge = np.zeros(words + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(words, start + n + span - 1), -1)
    return np.cumsum(edge)[:words] > 0


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, seed: int = SEED, with_text: bool = False, uid: str | None = None) -> DataFrame:
    """Removes each word that a repeated window covers, judged on the input.

    Returns one row per input row: _uid, doc_id, n_words, n_removed, kept_sha256 (and kept, the words
    left joined by one space, if asked for).  Null and empty texts have no words.  Null ids count
    as larger than all others; among rows with the same id, any one's window is the earlier.  A very long text is
    hashed in segments; an empty table gives an empty result; other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    base = scratch.cut(docs.select(number(uid).alias("_uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "base")
    there, marks = repeats(base, scratch, span, seed)
    scratch.release()
    fields = "_uid long, doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            marked = b.column(3).to_pylist() if b.num_columns > 3 else [None] * b.num_rows
            for text, m in zip(b.column(2).cast(pa.binary()).to_pylist(), marked, strict=True):
                if not m:
                    kept = b" ".join((text or b"").split())
                    n, gone = kept.count(b" ") + bool(kept), 0
                else:
                    w = Words(text)
                    drop = covered(w.n, m, span)
                    n, gone, kept = w.n, int(drop.sum()), w.join(~drop)
                rows.append((n, gone, hashlib.sha256(kept).hexdigest(), *[kept.decode()] * with_text))
            cols = list(zip(*rows, strict=True)) if rows else [()] * (3 + with_text)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=False)]], [f.split()[0] for f in fields.split(", ")])

    grouped = marks.groupBy("_uid").agg(F.collect_list("mark").alias("marks"))
    changed = there.select("_uid", "doc_id", "text").join(grouped, "_uid").transform(python_map, finish, fields)
    whole = base.transform(python_map, finish, fields)
    changed = scratch.cut(changed, "changed")
    return _either(whole, changed)


def _either(whole: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows of ``changed`` where they are, else of ``whole``."""
    c = changed.select("_uid", *[F.col(x).alias(f"_{x}2") for x in changed.columns if x not in ("_uid", "doc_id")])
    out = whole.join(c, "_uid", "left")
    return out.select("_uid", "doc_id", *[F.when(F.col("_n_removed2").isNotNull(), F.col(f"_{x}2")).otherwise(F.col(x)).alias(x) for x in changed.columns if x not in ("_uid", "doc_id")])
