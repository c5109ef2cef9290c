"""Phrase collocation mining by pivot partitioning.

Texts become sequences of word codes, chunk by chunk; the chunks' distinct words are summed to
word counts, and frequent words get numbers by falling count, so a larger number is a rarer word.
Every phrase belongs to its rarest word (the leftmost, if that occurs twice).  Around each
occurrence of a word a chunk sends the partition of that word a rewritten fragment: up to four words to
either side, cut at the first word that is infrequent, ends a piece, or is rarer than the
pivot.  So a partition holds all occurrences of its phrases, each once, and counts them alone;
it emits only phrases that its pivots own.  Equal fragments of a chunk are sent once with
their number.  A pivot with more occurrences than `PIECE` is split by its neighbours; the parts'
counts are added before the threshold, so no word gathers in one task.

Counts of parts, the closedness filter and the scores are joins and aggregates of the frequent phrases; scores
are integer divisions of decimals, exact up to 38 digits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from indexloom.llm.packed import Layout, bucket_of, by_bucket, chunks, layout, reduce_buckets, sized
from indexloom.llm.scratch import Scratch, by_key, spread
from indexloom.llm.text import mix
from indexloom.llm.workers import python_map

#: Words of a phrase at most, occurrences of a candidate at least, phrases of a language that a report holds.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Occurrences of a pivot in one part, about.
PIECE = 1 << 20
#: Positions of a chunk whose fragments are cut at a time.
SEGMENT = 1 << 20
#: Lower case for A-Z; marks and line ends that end a piece as a line feed, tab as a blank.
_BYTES = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


_CODED = "chunk long, seq binary, sizes array<struct<lang string, n long>>, parts array<struct<lang string, bucket int, code binary, word binary, n binary>>"
_SIZES = pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())]))
_PARTS = pa.list_(pa.struct([("lang", pa.string()), ("bucket", pa.int32()), ("code", pa.binary()), ("word", pa.binary()), ("n", pa.binary())]))


class _Codes(dict):
    """Codes of the words of one language, numbered on with those of the chunk's other languages."""

    def __init__(self, words: list[bytes]):
        super().__init__({b"\n": -1})
        self.words = words

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self.words)
        self.words.append(word)
        return code


def _coded(docs: DataFrame, dealt: Layout) -> DataFrame:
    """A row for each chunk of lang, text: its sequence of codes (-1 ends a piece), words of each language, and its distinct words, dealt by language and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for k, c in enumerate(chunks(batches, size=dealt.chunk)):
            words: list[bytes] = []
            codes: dict[str, _Codes] = {}
            seqs = []
            for lang, text in zip(c["lang"], c["text"], strict=True):
                if text:
                    known = codes.get(lang) or codes.setdefault(lang, _Codes(words))
                    found = filter(None, text.translate(_BYTES).replace(b"\n", b" \n ").split(b" "))
                    seqs += [np.fromiter(map(known.__getitem__, found), np.int32), np.full(1, -1, np.int32)]
            if not words:
                continue
            seq = np.concatenate(seqs)
            n = np.bincount(seq[seq >= 0], minlength=len(words))
            bucket = bucket_of(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) << np.uint64(32), dealt.buckets)
            sizes, parts = [], []
            for lang, known in codes.items():
                own = np.fromiter(known.values(), np.int32)[1:]
                sizes.append({"lang": lang, "n": int(n[own].sum())})
                for at, which in by_bucket(bucket[own]):
                    code = own[which]
                    parts.append({"lang": lang, "bucket": at, "code": code.tobytes(), "word": b"\n".join(map(words.__getitem__, code.tolist())), "n": n[code].tobytes()})
            yield pa.RecordBatch.from_arrays([pa.array([task + k]), pa.array([seq.tobytes()]), pa.array([sizes], _SIZES), pa.array([parts], _PARTS)], ["chunk", "seq", "sizes", "parts"])

    return python_map(docs, run, _CODED)


def _frequent(parts: DataFrame, dealt: Layout, least: int) -> DataFrame:
    """lang, bucket, word, f of the words of all chunks with ``least`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, f = None, {}
        for b in batches:
            for lang, bucket, word, n in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if (lang, bucket) != at:
                    yield from often(at, f)
                    at, f = (lang, bucket), {}
                for w, x in zip(word.split(b"\n"), np.frombuffer(n, np.int64).tolist(), strict=True):
                    f[w] = f.get(w, 0) + x
        yield from often(at, f)

    def often(at: tuple | None, f: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        kept = {w: n for w, n in f.items() if n >= least}
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([at[0]] * len(kept)), pa.array([at[1]] * len(kept), pa.int32()), pa.array(list(kept), pa.binary()).cast(pa.string()), pa.array(list(kept.values()))], ["lang", "bucket", "word", "f"])

    sent = parts.select("lang", "bucket", "word", "n").repartition(dealt.tasks, "lang", "bucket").sortWithinPartitions("lang", "bucket")
    return sent.transform(python_map, run, "lang string, bucket int, word string, f long")


def _known(parts: DataFrame, words: DataFrame, dealt: Layout) -> DataFrame:
    """chunk, code, id, parts (the three as arrays of int32): the frequent ones of each chunk's words, with the parts that a pivot is split into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, {}
        for b in batches:
            out = []
            for lang, bucket, chunk, code, word, entries in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if (lang, bucket) != at:
                    at, known = (lang, bucket), {}
                if chunk is None:  # the frequent words themselves, before the chunks
                    known = {e["word"].encode(): (e["id"], e["parts"]) for e in entries}
                    continue
                found = list(map(known.get, word.split(b"\n")))
                there = [i for i, x in enumerate(found) if x]
                if there:
                    own = np.array([found[i] for i in there], np.int32)
                    out.append((chunk, np.frombuffer(code, np.int32)[there].tobytes(), own[:, 0].tobytes(), own[:, 1].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["chunk", "code", "id", "parts"])

    entry = F.struct("word", "id", F.ceil(F.col("f") / PIECE).cast("int").alias("parts"))
    own = words.groupBy("lang", "bucket").agg(F.collect_list(entry).alias("entries"))
    own = own.select("lang", "bucket", F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("binary").alias("word"), "entries")
    asked = parts.select("lang", "bucket", "chunk", "code", "word", F.lit(None).cast("array<struct<word string, id int, parts int>>").alias("entries"))
    met = own.unionByName(asked).repartition(dealt.tasks, "lang", "bucket").sortWithinPartitions("lang", "bucket", F.col("chunk").asc_nulls_first())
    return met.transform(python_map, run, "chunk long, code binary, id binary, parts binary")


def _numbered(frequent: DataFrame, scratch: Scratch) -> DataFrame:
    """lang, bucket, word, f with ``id``: 1, 2, ... by falling f; a number of a range's row plus the rows of the ranges before."""
    order = [F.col("f").desc(), "lang", "word"]
    ranges = int(frequent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = frequent.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = scratch.cut(rows, "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range, whose number is a setting
    bases = rows.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    at = F.col("_at") - F.shiftleft(F.col("_range"), 33)
    return rows.withColumn("_range", F.shiftright("_at", 33)).join(bases, "_range").select("lang", "bucket", "word", "f", (F.col("_base") + at + 1).cast("int").alias("id"))


def _same(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, where a new row begins) that brings equal rows together."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(rows), np.uint64)
        for col in rows.T:
            h = (h ^ col.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h = mix(h)
    order = np.argsort(h)
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if (~new[1:] & (rows[order[1:]] != rows[order[:-1]]).any(axis=1)).any():  # two rows with one hash
        order = np.lexsort(rows.T)
        new[1:] = (rows[order[1:]] != rows[order[:-1]]).any(axis=1)
    return order, new


def _counted(rows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and their summed times."""
    if not len(rows):
        return rows, times
    order, new = _same(rows)
    at = np.flatnonzero(new)
    return rows[order[at]], np.add.reduceat(times[order], at)


def _fragments(ids: np.ndarray, reach: int) -> np.ndarray:
    """Rows (``reach`` words before, nearest last; the pivot; ``reach`` words after) of all pivots with a neighbour; 0 where cut."""
    padded = np.concatenate((np.zeros(reach, np.int32), ids, np.zeros(reach, np.int32)))
    found = []
    for lo in range(0, len(ids), SEGMENT):
        part = padded[lo : lo + SEGMENT + 2 * reach]
        n = len(part) - 2 * reach
        pivot = part[reach : reach + n]
        at = np.flatnonzero((pivot > 0) & (((part[reach - 1 : reach - 1 + n] > 0) & (part[reach - 1 : reach - 1 + n] < pivot)) | ((part[reach + 1 : reach + 1 + n] > 0) & (part[reach + 1 : reach + 1 + n] <= pivot))))
        own = pivot[at]
        rows = np.zeros((len(at), 2 * reach + 1), np.int32)
        rows[:, reach] = own
        for side in (-1, 1):
            going = np.ones(len(at), bool)
            for d in range(1, reach + 1):
                word = part[at + reach + side * d]
                going &= (word > 0) & ((word < own) if side < 0 else (word <= own))
                rows[:, reach + side * d] = np.where(going, word, 0)
        found.append(rows)
    return np.concatenate(found) if found else np.zeros((0, 2 * reach + 1), np.int32)


def _pack(table: np.ndarray) -> bytes:
    """Columns one after another, compressed."""
    return pa.compress(np.ascontiguousarray(table.T).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, rows: int, columns: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, rows * columns * 4, codec="zstd", asbytes=True), np.int32).reshape(columns, rows).T


def _mined(frags: np.ndarray, times: np.ndarray, parts: np.ndarray, longest: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrases padded with 0, occurrences) that the fragments' pivots own; those of pivots in one part that are rarer than ``least`` are left out.

    A phrase of l words before the pivot and r after it can be frequent only where those with one word less on
    either side are, so fragments drop out as phrases grow.
    """
    reach = longest - 1
    live = {(0, 0): np.ones(len(frags), bool)}
    for size in range(2, longest + 1):
        for left in range(size):
            right = size - 1 - left
            ok = np.ones(len(frags), bool)
            if left:
                ok &= live[left - 1, right] & (frags[:, reach - left] > 0)
            if right:
                ok &= live[left, right - 1] & (frags[:, reach + right] > 0)
            at = np.flatnonzero(ok)
            rows = frags[at, reach - left : reach + right + 1]
            stays = np.zeros(len(at), bool)
            if len(at):
                order, new = _same(rows)
                first = np.flatnonzero(new)
                n = np.add.reduceat(times[at[order]], first)
                good = (n >= least) | (parts[at[order[first]]] > 1)
                stays[order] = good[np.cumsum(new) - 1]
                out = np.zeros((int(good.sum()), longest), np.int32)
                out[:, :size] = rows[order[first[good]]]
                yield out, n[good]
            ok[at] = stays
            live[left, right] = ok


def frequent_phrases(docs: DataFrame, scratch: Scratch, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``docs`` has lang, text.  Returns frequent words (lang, bucket, word, f, id), all words by language (lang, n), and
    frequent phrases of 2 to ``longest`` words (gram: ids, f)."""
    docs = sized(docs, scratch)
    dealt, reach = layout(docs), longest - 1
    coded = scratch.cut(_coded(docs, dealt), "coded")
    total = coded.select(F.explode("sizes").alias("e")).groupBy("e.lang").agg(F.sum("e.n").alias("n"))
    parts = coded.select("chunk", F.explode("parts").alias("e")).select("chunk", "e.*")
    words = scratch.cut(_numbered(_frequent(parts, dealt, least), scratch), "words")
    known = _known(parts, words, dealt).groupBy("chunk").agg(F.collect_list(F.struct("code", "id", "parts")).alias("known"))
    rewritten = coded.select("chunk", "seq").join(by_key(known), "chunk")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                seq = np.frombuffer(b.column(1)[i].as_py(), np.int32)
                code, number, split = (np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in field]) for field in b.column(2)[i].values.flatten())
                lut = np.zeros(max(int(seq.max()), int(code.max())) + 2, np.int32)  # the last one for -1
                lut[code] = number
                by_id = np.argsort(number)
                frags, times = _fragments(lut[seq], reach), None
                frags, times = _counted(frags, np.ones(len(frags), np.int64))
                if not len(frags):
                    continue
                parts = split[by_id][np.searchsorted(number[by_id], frags[:, reach])]
                with np.errstate(over="ignore"):
                    near = mix(frags[:, reach - 1].astype(np.uint64) << np.uint64(32) | frags[:, reach + 1].astype(np.uint64))
                    owner = mix(frags[:, reach].astype(np.uint64) << np.uint64(32) | near % parts.astype(np.uint64))
                table = np.column_stack((frags, times.astype(np.int32), parts))
                rows = []
                for bucket, at in by_bucket(bucket_of(owner, dealt.buckets)):
                    at = at[np.argsort(frags[at, reach], kind="stable")]
                    rows.append((bucket, len(at), _pack(table[at])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "n", "data"])

    def mine(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        table = np.concatenate([_unpack(r["data"], r["n"], 2 * reach + 3) for r in rows])
        rows.clear()
        keyed, times = _counted(np.delete(table, 2 * reach + 1, axis=1), table[:, 2 * reach + 1].astype(np.int64))
        del table
        for grams, n in _mined(keyed[:, :-1], times, keyed[:, -1], longest, least):
            for lo in range(0, len(grams), 1 << 16):
                part = grams[lo : lo + (1 << 16)]
                sizes = (part > 0).sum(axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(part[part > 0]))
                yield pa.RecordBatch.from_arrays([lists, pa.array(n[lo : lo + (1 << 16)])], ["gram", "f"])

    sent = rewritten.transform(python_map, send, "bucket int, n int, data binary")
    found = reduce_buckets(sent, dealt.tasks, mine, "gram array<int>, f long")
    grams = found.groupBy("gram").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return words, scratch.cut(total, "totals"), scratch.cut(grams, "grams")


def _whole(x: Column | str) -> Column:
    """As a decimal whose products keep all digits: counts have 16, products 33, a thousand times that 38."""
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(16,0)")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """All candidates that no longer one with as many occurrences contains: lang, phrase, a, l, r, n, score.

    A phrase's occurrences are counted within pieces, overlapping ones too.  Null texts and empty ones have no
    words, a null language is ``und``; repeated rows count each; a very long text is one sequence like any other; an empty table gives
    an empty result; other columns are left out, whatever their names.  Scores are floors of 1000 a n / (l r) at
    the cut with the lowest one (ties: the first), exact for counts below 10^16.
    """
    scratch = Scratch(docs.sparkSession)
    words, total, grams = frequent_phrases(docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")), scratch, longest, least)
    size = F.size("gram")
    # a longer phrase with as many occurrences has one with a word less between it and the phrase, so those with one word more decide
    inner = grams.where(size > 2)
    held = inner.select(F.slice("gram", 1, size - 1).alias("gram"), "f").unionByName(inner.select(F.slice("gram", 2, size - 1).alias("gram"), "f")).distinct()
    free = grams.join(held, ["gram", "f"], "left_anti")
    counts = grams.where(size < longest).unionByName(words.select(F.array("id").alias("gram"), F.col("f").cast("long").alias("f")))
    cuts = free.select("gram", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.join(counts.select(F.col("gram").alias("_l"), F.col("f").alias("l")), F.slice("gram", F.lit(1), F.col("k")) == F.col("_l"))
    cuts = cuts.join(counts.select(F.col("gram").alias("_r"), F.col("f").alias("r")), F.slice("gram", F.col("k") + 1, size - F.col("k")) == F.col("_r")).drop("_l", "_r")
    # the language is that of any word
    cuts = cuts.join(words.select("id", "lang"), F.col("gram")[0] == F.col("id")).drop("id").join(total, "lang")
    cuts = cuts.withColumn("x", F.lit(1000).cast("decimal(4,0)") * (_whole("a") * _whole("n"))).withColumn("y", _whole("l") * _whole("r")).withColumn("score", F.expr("x div y"))
    best = cuts.groupBy("lang", "gram", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    spelt = best.select("gram", F.posexplode("gram").alias("i", "id")).join(words.select("id", "word"), "id").groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))
    spelt = spelt.select("gram", F.array_join(F.col("w.word"), " ").alias("phrase"))
    return best.join(spelt, "gram").select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")


def report(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language by score and occurrences, both falling, then phrase: lang, rank, phrase, a, l, r, n, score.

    Ranked within parts of a language first, so one language's phrases need not fit in one task.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = spread(top * top)
    near = found.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)).cast("int"))
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_r") <= top)
    last = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return last.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
