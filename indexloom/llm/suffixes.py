"""Suffix-array dedup: equal runs of bytes by deep-shallow sorting.

A string of 100 bytes is removed where it also starts earlier.  Suffixes are cut at 100 bytes and sorted, so equal
ones are neighbours.  The sort is deep-shallow: multikey quicksort orders suffixes by their first
24 bytes (eight characters to a key), and groups that still agree are ordered by blind
tries: a trie node keeps the position and the byte of a branch alone, one leaf of a group is compared with the
others, and these fall into the subtrees that branch off its path, which are groups in turn.  All groups of a task are
worked on together, in numpy.

Suffixes are dealt by content: the smallest hash of the 48-byte runs inside a string (the last of
equal ones) is its anchor, so equal strings have equal anchors and meet in one task.  First, chunks of documents send
five bytes of each anchor and get back a bit that says whether it occurs again; only strings behind
repeated anchors are sorted.  Strings that share an anchor overlap, so they travel as one piece of text, a zone.
Zones are sorted first and the strings of distinct ones then.  A chunk sends each distinct zone once, with its first
place, so what a third of the corpus shares does not gather in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indexloom.llm.packed import bucket_of, by_bucket, chunks, layout, reduce_buckets, sized
from indexloom.llm.scratch import Scratch, by_key
from indexloom.llm.text import _TABLE, POWERS, mix
from indexloom.llm.workers import python_map

#: Bytes of a string, of the runs that anchors are chosen from, and of the depth to which multikey quicksort goes.
SPAN, SEED, SHALLOW = 100, 48, 24
#: Bytes whose strings are hashed at a time, and strings that are sorted together at most before a task goes on to the next anchors.
SEGMENT, SORTED = 1 << 19, 1 << 18
#: Bytes of an anchor that are sent.
MARK = 5
_NULL = np.iinfo(np.int64).max


class Suffixes:
    """Bytes with positions in them, to be ordered."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        padded = np.concatenate((data, np.zeros(16, np.uint8)))
        self.words = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
        self.starts, self.lengths = starts, lengths

    def word(self, which: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
        """Eight bytes from a depth on, as a number; bytes beyond the length are 0."""
        left = self.lengths[which] - depth
        at = np.where(left > 0, self.starts[which] + depth, 0)
        w = self.words[at].view(">u8").ravel().astype(np.uint64)
        short = np.clip(8 - left, 0, 8).astype(np.uint64) * np.uint64(8)
        return np.where(left > 0, w >> np.minimum(short, np.uint64(63)) << np.minimum(short, np.uint64(63)), np.uint64(0))


def _regroup(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, where a run of equal (group, key) begins) of members of groups."""
    by = np.lexsort((key, group))
    new = np.ones(len(by), bool)
    new[1:] = (group[by[1:]] != group[by[:-1]]) | (key[by[1:]] != key[by[:-1]])
    return by, new


def deep_shallow(s: Suffixes, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether a suffix differs from the one before) of suffixes; shorter lengths come first, bytes decide among equal ones."""
    n = len(s.starts)
    order, differs = np.argsort(s.lengths, kind="stable"), np.zeros(n, bool)
    if not n:
        return order, differs
    differs[0] = True
    differs[1:] = s.lengths[order[1:]] != s.lengths[order[:-1]]
    slot = np.arange(n)
    depth = 0

    def shared(slot: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of groups of two at least, and their groups."""
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        return slot[many], group[many]

    slot, group = shared(slot, differs)
    while depth < shallow and len(slot):  # multikey quicksort
        who = order[slot]
        by, new = _regroup(group, s.word(who, depth))
        order[slot] = who[by]
        differs[slot] |= new
        slot, group = shared(slot, new)
        depth += 8
    common = np.full(len(slot), depth)
    while len(slot):  # blind tries
        who = order[slot]
        first = np.ones(len(slot), bool)
        first[1:] = group[1:] != group[:-1]
        run = np.cumsum(first) - 1
        leaf = who[np.flatnonzero(first) + np.bincount(run) // 2][run]
        side, branch, byte = np.ones(len(slot), np.int64), np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
        open_, at = np.arange(len(slot)), common.copy()
        while len(open_):
            mine, other = s.word(who[open_], at[open_]), s.word(leaf[open_], at[open_])
            apart = mine != other
            x = (mine ^ other)[apart]
            same = np.zeros(len(x), np.int64)  # leading bytes that agree
            for k in range(1, 8):
                same += (x >> np.uint64(64 - 8 * k)) == 0
            i = open_[apart]
            branch[i] = at[i] + same
            byte[i] = (mine[apart] >> (np.uint64(56) - np.uint64(8) * same.astype(np.uint64))) & np.uint64(255)
            side[i] = np.where(mine[apart] < other[apart], 0, 2)
            open_ = open_[~apart]
            at[open_] += 8
            open_ = open_[at[open_] < s.lengths[who[open_]]]
        depths = np.where(side == 0, branch, np.int64(1 << 40) - branch) * (side != 1)
        by, new = _regroup(group, (side << 52) + (depths << 8) + byte)
        order[slot] = who[by]
        differs[slot] |= new
        side, branch = side[by], branch[by]
        go_on = side != 1
        inside = np.cumsum(new) - 1
        many = (np.bincount(inside)[inside] > 1) & go_on
        slot, group, common = slot[many], inside[many], branch[many] + 1
    return order, differs


def zones(data: np.ndarray, ends: np.ndarray, span: int = SPAN, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, anchor's hash) of runs of strings with one anchor; ``ends`` of the documents in ``data``."""
    begins = np.concatenate(([0], ends[:-1]))
    width = span - seed + 1
    lows, counts, hashes = [], [], []
    for lo in range(0, len(data), SEGMENT):
        part = data[lo : lo + SEGMENT + span - 1]
        m = len(part) - span + 1
        if m <= 0:
            continue
        up, down = POWERS[0].get(len(part) + 1)
        with np.errstate(over="ignore"):
            acc = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[0][part] * up[: len(part)], dtype=np.uint64)))
            h = mix((acc[seed:] - acc[:-seed]) * down[: len(part) - seed + 1])
        del acc
        # the smaller hash first, of equal ones the later place
        low = (h & ~np.uint64(0xFFFFFFFF)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
        size = 1
        while 2 * size <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[:m], low[width - size : width - size + m])
        anchor = (np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype(np.int64)
        # strings inside one document
        edge = np.zeros(m + 1, np.int32)
        a, b = begins - lo, ends - lo - span + 1
        there = (b > a) & (b > 0) & (a < m)
        np.add.at(edge, np.clip(a[there], 0, m), 1)
        np.add.at(edge, np.clip(b[there], 0, m), -1)
        inside = np.flatnonzero(np.cumsum(edge[:m]) > 0)
        if not len(inside):
            continue
        own = anchor[inside]
        cut = np.ones(len(inside), bool)
        cut[1:] = (own[1:] != own[:-1]) | (inside[1:] != inside[:-1] + 1)
        at = np.flatnonzero(cut)
        lows.append(inside[at] + lo)
        counts.append(np.diff(np.append(at, len(inside))))
        hashes.append(h[own[at]])
    if not lows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(lows), np.concatenate(counts), np.concatenate(hashes)


def _first(order: np.ndarray, differs: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each member, whether its place is the first of its equal ones; ``place``: columns, the first decides."""
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(differs) - 1
    by = np.lexsort((*place.T[::-1], group))
    lead = np.ones(len(order), bool)
    lead[1:] = group[by[1:]] != group[by[:-1]]
    out = np.zeros(len(order), bool)
    out[by[lead]] = True
    return out


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Pieces of bytes one after another."""
    ends = np.cumsum(sizes)
    return data[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def later_strings(data: np.ndarray, low: np.ndarray, n: np.ndarray, anchor: np.ndarray, place: np.ndarray, span: int = SPAN, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(zone, first string of it, strings) of those that start earlier elsewhere.

    Zones: ``low`` and ``n`` strings in ``data``; ``place``: rank, chunk and start of the first string.
    """
    lead = _first(*deep_shallow(Suffixes(data, low, n + span - 1), shallow), place)
    again = np.flatnonzero(~lead)
    found = [(again, np.zeros(len(again), np.int64), n[again])]
    # strings of different zones can only be equal where these share an anchor
    own = np.flatnonzero(lead)
    own = own[np.argsort(anchor[own], kind="stable")]
    new = np.ones(len(own), bool)
    new[1:] = anchor[own[1:]] != anchor[own[:-1]]
    run = np.cumsum(new) - 1
    keep = np.bincount(run)[run] > 1 if len(own) else new
    own, run = own[keep], run[keep]
    total = np.cumsum(n[own])
    lo = 0
    while lo < len(own):
        # whole anchors, some strings together
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SORTED, "right"))
        hi = int(np.searchsorted(run, run[min(max(hi, lo), len(own) - 1)], "left")) if hi < len(own) else len(own)
        if hi <= lo:
            hi = int(np.searchsorted(run, run[lo], "right"))
        zone = np.repeat(own[lo:hi], n[own[lo:hi]])
        step = np.arange(len(zone)) - np.repeat(np.cumsum(n[own[lo:hi]]) - n[own[lo:hi]], n[own[lo:hi]])
        at = place[zone]
        at[:, -1] += step
        late = np.flatnonzero(~_first(*deep_shallow(Suffixes(data, low[zone] + step, np.full(len(zone), span)), shallow), at))
        z, k = zone[late], step[late]
        head = np.ones(len(late), bool)
        head[1:] = (z[1:] != z[:-1]) | (k[1:] != k[:-1] + 1)
        i = np.flatnonzero(head)
        found.append((z[i], k[i], np.diff(np.append(i, len(late)))))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _unpacked(data: bytes, zones: int, strings: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Zones (rank, start * 256 + strings, anchor) and their bytes, as sent."""
    whole = pa.decompress(data, 24 * zones + strings + zones * (span - 1), codec="zstd", asbytes=True)
    return np.frombuffer(whole, np.int64, 3 * zones).reshape(3, zones).T, np.frombuffer(whole, np.uint8, offset=24 * zones)


_BASE = "chunk long, doc_id array<long>, ends binary, size long, data binary"


def _texts(row_size: int, data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, row_size, codec="zstd", asbytes=True), np.uint8)


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, seed: int = SEED, with_kept: bool = False) -> DataFrame:
    """Removes each byte that a repeated string covers, judged on the input.

    Returns one row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (and ``kept``, the bytes
    left, if asked for).  Null and empty texts have no bytes.  Null ids count as larger than all others; among rows with the
    same id, any one's string is the earlier, the same in every run of a job.  A very long text is hashed in segments; an
    empty table gives an empty result; other columns are left out, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    plain = sized(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")), scratch)
    dealt = layout(plain)
    buckets = dealt.buckets

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for k, c in enumerate(chunks(batches, size=dealt.chunk)):
            texts = [t or b"" for t in c["text"]]
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            data = b"".join(texts)
            cols = [pa.array([task + k]), pa.array([c["doc_id"]], pa.list_(pa.int64())), pa.array([ends.tobytes()]), pa.array([len(data)]), pa.array([pa.compress(data, codec="zstd", asbytes=True)])]
            yield pa.RecordBatch.from_arrays(cols, ["chunk", "doc_id", "ends", "size", "data"])

    base = scratch.cut(python_map(plain, pack, _BASE), "chunks", "none")  # texts are compressed already

    def rows_of(b: pa.RecordBatch) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, object]]:
        for i in range(b.num_rows):
            ends = np.frombuffer(b.column(2)[i].as_py(), np.int64)
            yield b.column(0)[i].as_py(), b.column(1)[i].values, ends, _texts(b.column(3)[i].as_py(), b.column(4)[i].as_py()), b.column(5)[i].as_py() if b.num_columns > 5 else None

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, _, ends, data, _ in rows_of(b):
                h = np.unique(zones(data, ends, span, seed)[2])
                out = [(x, chunk, np.ascontiguousarray(h[at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :MARK]).tobytes()) for x, at in by_bucket(bucket_of(h, buckets))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["bucket", "chunk", "anchors"])

    def meet(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        marks = [np.frombuffer(r["anchors"], np.uint8).reshape(-1, MARK) for r in rows]
        wide = np.zeros((sum(map(len, marks)), 8), np.uint8)
        wide[:, :MARK] = np.concatenate(marks)
        value = wide.view("<u8").ravel()
        order = np.argsort(value)
        twice = np.zeros(len(value), bool)
        same = value[order[1:]] == value[order[:-1]]
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        ends = np.cumsum([len(m) for m in marks])
        bits = [np.packbits(t).tobytes() for t in np.split(twice, ends[:-1])]
        yield pa.RecordBatch.from_arrays([pa.array([r["chunk"] for r in rows]), pa.array([r["bucket"] for r in rows], pa.int32()), pa.array(bits)], ["chunk", "bucket", "bits"])

    sent = base.select("chunk", "doc_id", "ends", "size", "data").transform(python_map, anchors, "bucket int, chunk long, anchors binary")
    bits = scratch.cut(reduce_buckets(sent, dealt.tasks, meet, "chunk long, bucket int, bits binary").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("again")), "bits")
    del sent
    scratch.release()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, ids, ends, data, again in rows_of(b):
                low, n, h = zones(data, ends, span, seed)
                known, at, times = np.unique(h, return_inverse=True, return_counts=True)
                often = times > 1
                home = bucket_of(known, buckets)
                for part in again:
                    lo, hi = np.searchsorted(home, [part["bucket"], part["bucket"] + 1])
                    often[lo:hi] |= np.unpackbits(np.frombuffer(part["bits"], np.uint8), count=hi - lo).astype(bool)
                keep = often[at]
                low, n, h = low[keep], n[keep], h[keep]
                if not len(low):
                    continue
                rank = ids.fill_null(_NULL).to_numpy(zero_copy_only=False)[np.searchsorted(ends, low, "right")]
                # of equal zones of the chunk the first goes, the others are late for certain
                lead = _first(*deep_shallow(Suffixes(data, low, n + span - 1)), np.column_stack((rank, low)))
                late = np.flatnonzero(~lead)
                own = np.flatnonzero(lead)
                out = [(int(chunk % buckets), chunk, 0, 0, b"", (low[late] * 256 + n[late]).tobytes())] if len(late) else []
                for x, which in by_bucket(bucket_of(h[own], buckets)):
                    z = own[which]
                    table = np.vstack((rank[z], low[z] * 256 + n[z], h[z].view(np.int64)))
                    packed = pa.compress(table.tobytes() + _gathered(data, low[z], n[z] + span - 1).tobytes(), codec="zstd", asbytes=True)
                    out.append((x, chunk, len(z), int(n[z].sum()), packed, b""))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "chunk", "zones", "strings", "data", "late"])

    def sort(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        late = [(r["chunk"], r["late"]) for r in rows if r["late"]]
        rows = [r for r in rows if r["zones"]]
        if rows:
            chunk = np.repeat(np.array([r["chunk"] for r in rows], np.int64), [r["zones"] for r in rows])
            parts = [_unpacked(r["data"], r["zones"], r["strings"], span) for r in rows]
            rows.clear()
            z, data = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            start, n = z[:, 1] >> 8, z[:, 1] & 255
            ends = np.cumsum(n + span - 1)
            zone, step, k = later_strings(data, ends - (n + span - 1), n, z[:, 2], np.column_stack((z[:, 0], chunk, start)), span)
            mark = (start[zone] + step) * 256 + k
            of = chunk[zone]
            by = np.argsort(of, kind="stable")
            cuts = np.flatnonzero(np.diff(of[by])) + 1
            late += [(int(of[x[0]]), mark[x].tobytes()) for x in np.split(by, cuts) if len(x)]
        if late:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*late, strict=True), (pa.int64(), pa.binary()), strict=True)], ["chunk", "marks"])

    zoned = base.join(by_key(bits), "chunk").transform(python_map, send, "bucket int, chunk long, zones int, strings long, data binary, late binary")
    marks = scratch.cut(reduce_buckets(zoned, dealt.tasks, sort, "chunk long, marks binary").groupBy("chunk").agg(F.collect_list("marks").alias("marks")), "marks")
    del zoned
    scratch.release()
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, ids, ends, data, found in rows_of(b):
                edge = np.zeros(len(data) + 1, np.int16)
                if found:
                    m = np.frombuffer(b"".join(found), np.int64)
                    np.add.at(edge, m >> 8, 1)
                    np.add.at(edge, (m >> 8) + (m & 255) + span - 1, -1)
                gone = np.cumsum(edge, dtype=np.int16)[: len(data)] > 0
                out, lo = [], 0
                for hi in ends.tolist():
                    g, text = gone[lo:hi], data[lo:hi]
                    removed = int(np.count_nonzero(g))
                    spans = int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1])) if removed else 0
                    kept = text[~g].tobytes() if removed else text.tobytes()
                    out.append((hi - lo, removed, spans, hashlib.sha256(kept).hexdigest(), *[kept] * with_kept))
                    lo = hi
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c) for c in cols]], [f.split()[0] for f in fields.split(", ")])

    return base.join(by_key(marks), "chunk", "left").transform(python_map, finish, fields)
