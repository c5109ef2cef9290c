"""Cross-tokenizer alignment by id-striped dense count matrices.

Two tokenizers encode each text; byte offsets where tokens of both end cut it into groups, and the two tokens
that end a group are linked.  A part of a chunk of documents is one row of a written table: its
documents, their sequence of units and the links of each distinct unit.  A unit is a run of blanks
and the word behind it: neither tokenizer has a token across such a border (this is looked up
in their files; other pairs of tokenizers, and texts with other white space, are encoded
whole), so each distinct unit of a chunk is encoded and aligned once, whatever its occurrences.  Chunks and
parts have fixed sizes, and so have the rows that are sorted, shuffled and scored, at any size of the corpus.

A part sends its distinct id pairs with their counts to the stripe of the second id: 64 of its ids by
all first ids, a dense block to which ``np.add.at`` adds.  Row maxima of the block give the
best partner of each second id.  Where many of them meet in a stripe they are added in several tasks, whose blocks are
added again.  The stripe's counts go back to the parts that sent the pairs, so scores are summed where the links
are; a part gets as many numbers as it has distinct pairs, and no link is shuffled alone.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indexloom.llm import packed
from indexloom.llm.packed import chunks, layout, sized
from indexloom.llm.scratch import Scratch, by_key
from indexloom.llm.tokens import _byte_characters
from indexloom.llm.workers import python_map

#: Second ids of a stripe; tasks for each part of the stripes.
STRIPE, TASKS = 64, 64
#: Units that are encoded and aligned together; bytes of text of a row, about.
UNITS, PART = 1 << 15, 1 << 20
#: How the first vocabulary splits texts, and the mark of a second one that leaves texts as they are.
SPLITTER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
UNCHANGED = b"\x0a\x08identity"
_UNIT = re.compile(rb"[ \t\n]*[^ \t\n]+|[ \t\n]+")
#: White space that is not a blank, tab or line feed (and characters that some count as such), in UTF-8.
_ODD = re.compile(rb"[\x0b-\x0d\x1c-\x1f]|\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2\x80[\x80-\x8b\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xef\xbb\xbf")
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


class Aligned:
    """What units give, one after another: whether their bytes are their tokens', numbers of tokens and groups, groups as text, and the two last ids of each group."""

    def __init__(self, n: int):
        self.good = np.zeros(n, bool)
        self.n_a, self.n_b, self.n_groups = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.shown = [b""] * n
        self.a = self.b = np.zeros(0, np.int64)

    def extend(self, other: Aligned) -> None:
        for k in ("good", "n_a", "n_b", "n_groups", "a", "b"):
            setattr(self, k, np.concatenate((getattr(self, k), getattr(other, k))))
        self.shown += other.shown


class Aligner:
    """Encodes with both tokenizers and aligns, many units at a time."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(first)
        self.tok.encode_special_tokens = True
        self.pieces = SentencePieceProcessor(model_file=second)
        made = json.loads(self.tok.to_str())
        byte = {c: b for b, c in _byte_characters().items()}
        self.a_size, b_size = self.tok.get_vocab_size(), self.pieces.get_piece_size()
        self.a_bytes = [bytes(byte.get(c, 32) for c in self.tok.id_to_token(i) or "") for i in range(self.a_size)]
        names = [self.pieces.id_to_piece(i) for i in range(b_size)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.sizes = [np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes)]
        numbers = [str(i).encode() for i in range(max(self.a_size, b_size))]
        self.width = np.array([len(x) for x in numbers], np.int64)
        self.digits = np.array([list(x.ljust(int(self.width.max()))) for x in numbers], np.uint8)
        crossing = any(c in " \t\n" and p[k] not in " \t\n" for p in (n.replace("▁", " ") for n in names) for k, c in enumerate(p[1:]))
        self.by_unit = made["normalizer"] is None and made["pre_tokenizer"] == SPLITTER and UNCHANGED in self.pieces.serialized_model_proto() and not crossing
        self.lead = len(self.pieces.encode("x"))

    def align(self, a: list[Sequence[int]], b: list[Sequence[int]], texts: list[bytes]) -> Aligned:
        """Units of which the tokens' bytes are not those of the text are not good and have no tokens."""
        out = Aligned(len(texts))
        goal = np.fromiter(map(len, texts), np.int64, len(texts))
        out.good[:] = True
        for lists, size in zip((a, b), self.sizes, strict=True):
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum()))
            out.good &= np.diff(np.concatenate(([0], np.cumsum(size[flat])))[np.concatenate(([0], np.cumsum(n)))]) == goal
        at = np.flatnonzero(out.good).tolist()
        own = [texts[i] for i in at]
        if any(b"".join(map(table.__getitem__, chain.from_iterable(lists[i] for i in at))) != b"".join(own) for table, lists in ((self.a_bytes, a), (self.b_bytes, b))):
            at = [i for i in at if all(b"".join(map(table.__getitem__, lists[i])) == texts[i] for table, lists in ((self.a_bytes, a), (self.b_bytes, b)))]
            own = [texts[i] for i in at]
            out.good[:] = False
            out.good[at] = True
        if not at:
            return out
        borders = np.cumsum(goal[at])  # bytes of all good units, one after another
        flat, ends = [], []
        for lists, size, per in ((a, self.sizes[0], out.n_a), (b, self.sizes[1], out.n_b)):
            per[at] = [len(lists[i]) for i in at]
            flat.append(np.fromiter(chain.from_iterable(lists[i] for i in at), np.int64, int(per.sum())))
            ends.append(np.cumsum(size[flat[-1]]))
        (fa, fb), (ea, eb) = flat, ends
        last_a, last_b = eb[np.searchsorted(eb, ea)] == ea, ea[np.searchsorted(ea, eb)] == eb  # both end at the units' ends
        out.a, out.b = fa[last_a], fb[last_b]
        closed = np.searchsorted(ea[last_a], borders, "right")
        out.n_groups[at] = np.diff(closed, prepend=0)
        # the ids of a group's first tokens, then of its second ones, each with the mark behind it
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        all_a, all_b = np.cumsum(np.bincount(group_a)), np.cumsum(np.bincount(group_b))
        place_a = np.arange(len(fa)) + np.concatenate(([0], all_b))[group_a]
        place_b = np.arange(len(fb)) + all_a[group_b]
        ids, marks = np.empty(len(fa) + len(fb), np.int64), np.empty(len(fa) + len(fb), np.uint8)
        ids[place_a], ids[place_b] = fa, fb
        marks[place_a], marks[place_b] = np.where(last_a, 124, 44), np.where(last_b, 59, 44)  # | ; and commas
        size = self.width[ids]
        stop = np.cumsum(size + 1)
        text = np.empty(int(stop[-1]), np.uint8)
        for k in range(self.digits.shape[1]):
            here = np.flatnonzero(size > k)
            text[stop[here] - 1 - size[here] + k] = self.digits[ids[here], k]
        text[stop - 1] = marks
        shown = text.tobytes()
        tokens = np.cumsum(out.n_a[at] + out.n_b[at])
        lo = 0
        for i, hi in zip(at, stop[tokens - 1].tolist(), strict=True):
            out.shown[i] = shown[lo : hi - 1]
            lo = hi
        return out

    def wholes(self, texts: list[bytes]) -> Aligned:
        """Texts (without the blank before them) through both tokenizers."""
        plain = [t.decode() for t in texts]
        first = self.tok.encode_batch_fast([" " + p for p in plain], add_special_tokens=False)
        return self.align([e.ids for e in first], self.pieces.encode(plain, num_threads=1), [b" " + t for t in texts])

    def units(self, found: list[bytes]) -> Aligned:
        """Distinct units; the blank that the second tokenizer puts before texts goes to an x."""
        out = Aligned(0)
        for lo in range(0, len(found), UNITS):
            part = found[lo : lo + UNITS]
            plain = [u.decode() for u in part]
            first = self.tok.encode_batch_fast(plain, add_special_tokens=False)
            second = self.pieces.encode(["x" + p for p in plain], num_threads=1)
            out.extend(self.align([e.ids for e in first], [b[self.lead :] for b in second], part))
        return out


def aligner(first: str, second: str) -> Aligner:
    """The worker's aligner of two vocabulary files, kept between tasks until a later phase begins."""
    if (first, second) not in _ALIGNERS:
        _ALIGNERS[first, second] = Aligner(first, second)
    return _ALIGNERS[first, second]


def _retire() -> None:
    """In phases that encode nothing: the worker's vocabularies (some 100 MB) are given up."""
    _ALIGNERS.clear()


class _Codes(dict):
    """Numbers of things in order of their first use."""

    def __missing__(self, x: bytes) -> int:
        code = self[x] = len(self)
        return code


_STRIPES = pa.list_(pa.struct([("stripe", pa.int32()), ("lo", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))
_LINKS = "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, ends binary, seq binary, unit_ends binary, unit_pairs binary, n_pairs int, stripes array<struct<stripe int, lo int, keys binary, counts binary>>"


def _encoded(texts: list[bytes | None], known: Aligner) -> tuple[Aligned, list[np.ndarray]]:
    """The distinct units of a chunk, and the units of each text: none if one of them is not good."""
    codes, odd = _Codes(), {}
    seqs: list[np.ndarray] = []
    for i, t in enumerate(texts):
        if not t:
            seqs.append(np.zeros(0, np.int32))
        elif not known.by_unit or _ODD.search(t):
            odd[i] = t
            seqs.append(np.zeros(0, np.int32))
        else:
            seqs.append(np.fromiter(map(codes.__getitem__, _UNIT.findall(b" " + t)), np.int32))
    units = known.units(list(codes))
    for n, (i, t) in enumerate(odd.items(), len(codes)):  # a text encoded whole is a unit of its own
        seqs[i] = np.full(1, n, np.int32)
        units.extend(known.wholes([t]))
    return units, [s if units.good[s].all() else s[:0] for s in seqs]


def _narrow(x: np.ndarray, below: int) -> bytes:
    """Numbers under ``below`` in two bytes each, if that is enough, or four."""
    return x.astype(np.uint16 if below <= 1 << 16 else np.int32).tobytes()


def _wide(data: pa.Buffer, n: int) -> np.ndarray:
    """The ``n`` numbers of ``_narrow``."""
    return np.frombuffer(data, np.uint16 if data.size == 2 * n else np.int32)


def _row(ids: list, seqs: list[np.ndarray], units: Aligned, known: Aligner) -> tuple[list, ...]:
    """The columns of ``_LINKS`` behind the chunk's number, for some documents of a chunk and the units that they have."""
    n_a, n_b, n_groups, shown = units.n_a, units.n_b, units.n_groups, units.shown
    sums, shas = [], []
    for s in seqs:
        sums.append((int(n_a[s].sum()), int(n_b[s].sum()), int(n_groups[s].sum())))
        shas.append(hashlib.sha256(b";".join(map(shown.__getitem__, s.tolist()))).hexdigest() if len(s) else "")
    seq = np.concatenate(seqs) if seqs else np.zeros(0, np.int32)
    ends = np.cumsum([len(s) for s in seqs], dtype=np.int64)
    times = np.bincount(seq, minlength=len(n_groups))
    own = np.flatnonzero(times)
    seq = (np.cumsum(times > 0) - 1)[seq]
    size = n_groups[own]
    unit_ends = np.cumsum(size)
    at = np.repeat((np.cumsum(n_groups) - n_groups)[own] - (unit_ends - size), size)
    at += np.arange(len(at))
    a, b = units.a[at], units.b[at]
    used = np.repeat(times[own], size)
    keys, pair = np.unique(b * known.a_size + a, return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, pair, used)
    stripe = keys // (known.a_size * STRIPE)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(stripe)) + 1, [len(keys)])) if len(keys) else np.zeros(1, np.int64)
    stripes = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        s = int(stripe[lo])
        stripes.append({"stripe": s, "lo": lo, "keys": (keys[lo:hi] - s * known.a_size * STRIPE).astype(np.int32).tobytes(), "counts": counts[lo:hi].tobytes()})
    per = list(zip(*sums, strict=True)) or [(), (), ()]
    return ids, *map(list, per), shas, ends.tobytes(), _narrow(seq, len(own)), unit_ends.astype(np.int32).tobytes(), _narrow(pair, len(keys)), len(keys), stripes


def _linked(ids: list, texts: list[bytes | None], known: Aligner) -> tuple[list, ...]:
    """A chunk as one row."""
    units, seqs = _encoded(texts, known)
    return _row(ids, seqs, units, known)


def _parts(ids: list, texts: list[bytes | None], known: Aligner, size: int) -> Iterator[tuple[list, ...]]:
    """A chunk as rows of consecutive documents with about ``size`` bytes of text together, one document at least."""
    units, seqs = _encoded(texts, known)
    part = np.cumsum([len(t or b"") for t in texts]) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(ids)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield _row(ids[lo:hi], seqs[lo:hi], units, known)


def _added(rows: DataFrame, keys: list[str], width: int, tasks: int, best: bool) -> DataFrame:
    """Adds the counts of each group of ``keys`` (stripe first) in a dense block; returns its entries, one row a group.

    ``best``: also whether an entry is the largest of its second id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _retire()
        block, at = np.zeros(STRIPE * width, np.int64), None
        for b in batches:
            for group, k, n in zip(zip(*(b.column(i).to_pylist() for i in range(len(keys))), strict=True), b.column(len(keys)), b.column(len(keys) + 1), strict=True):
                if group != at:
                    if at is not None:
                        yield entries(at, block)
                    block[:] = 0
                    at = group
                np.add.at(block, np.frombuffer(k.as_buffer(), np.int32), np.frombuffer(n.as_buffer(), np.int64))
        if at is not None:
            yield entries(at, block)

    def entries(at: tuple, block: np.ndarray) -> pa.RecordBatch:
        there = np.flatnonzero(block)
        n = block[there]
        cols = [pa.array([at[0]], pa.int32()), pa.array([there.astype(np.int32).tobytes()]), pa.array([n.tobytes()])]
        if best:
            cols.append(pa.array([(n == block.reshape(STRIPE, width).max(axis=1)[there // width]).tobytes()]))
        return pa.RecordBatch.from_arrays(cols, ["stripe", "keys", "counts", "best"][: len(cols)])

    sent = rows.select(*keys, "keys", "counts").repartition(tasks, *keys).sortWithinPartitions(*keys)
    return sent.transform(python_map, run, "stripe int, keys binary, counts binary" + ", best binary" * best)


def align(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``first`` is a byte-level vocabulary of the tokenizers library, which gets a blank and the text, ``second`` a
    sentencepiece model, which puts the blank there itself.  Null and empty texts, and those whose
    tokens' bytes differ from blank and text, have no tokens: zeros and ''.  Repeated rows and null ids count like others; ties
    for the best partner all count; a very long text is in one row; an empty table gives an empty result; other columns are
    left out, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    plain = sized(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")), scratch)
    dealt = layout(plain)
    width = aligner(first, second).a_size
    chunk, part = packed.CHUNK, PART  # not the layout's chunk, which grows with its buckets

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = aligner(first, second), count(TaskContext.get().partitionId() << 32)
        kinds = [pa.int64(), *[pa.list_(pa.int64())] * 4, pa.list_(pa.string()), *[pa.binary()] * 4, pa.int32(), _STRIPES]
        for c in chunks(batches, size=chunk):
            for row in _parts(c["doc_id"], c["text"], known, part):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((next(number), *row), kinds, strict=True)], [f.split()[0] for f in _LINKS.split(", ")[:11]] + ["stripes"])

    links = scratch.cut(python_map(plain, link, _LINKS), "links")
    parts = -(-dealt.tasks // TASKS)
    pairs = links.select("chunk", F.explode("stripes").alias("s")).select("chunk", "s.stripe", "s.lo", "s.keys", "s.counts").withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int"))
    counts = scratch.cut(_added(_added(pairs, ["stripe", "part"], width, dealt.tasks, best=False), ["stripe"], width, dealt.tasks, best=True), "counts")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _retire()
        n, best = np.zeros(STRIPE * width, np.int64), np.zeros(STRIPE * width, bool)
        for b in batches:
            out = []
            for chunk, lo, k, c, f in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5), b.column(6), strict=True):
                keys = np.frombuffer(k.as_buffer(), np.int32)
                if chunk is None:  # the stripe's own counts, before the chunks' rows
                    n[keys], best[keys] = np.frombuffer(c.as_buffer(), np.int64), np.frombuffer(f.as_buffer(), bool)
                else:
                    out.append((chunk, lo, n[keys].tobytes(), best[keys].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["chunk", "lo", "n", "best"])

    asked = pairs.select("stripe", "part", "chunk", "lo", "keys", F.lit(None).cast("binary").alias("counts"), F.lit(None).cast("binary").alias("best"))
    known = counts.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("int").alias("lo"), "keys", "counts", "best")
    met = known.unionByName(asked).repartition(dealt.tasks, "stripe", "part").sortWithinPartitions("stripe", "part", F.col("chunk").asc_nulls_first())
    back = met.transform(python_map, answer, "chunk long, lo int, n binary, best binary")
    back = back.groupBy("chunk").agg(F.collect_list(F.struct("lo", "n", "best")).alias("back"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _retire()
        for b in batches:
            for i in range(b.num_rows):
                ids, n_a, n_b, groups, shas = (b.column(k)[i].values for k in range(1, 6))
                ends, unit_ends = np.frombuffer(b.column(6)[i].as_buffer(), np.int64), np.frombuffer(b.column(8)[i].as_buffer(), np.int32)
                seq, unit_pairs = (_wide(b.column(k)[i].as_buffer(), int(stop[-1]) if len(stop) else 0) for k, stop in ((7, ends), (9, unit_ends)))
                n, best = np.zeros(b.column(10)[i].as_py(), np.int64), np.zeros(b.column(10)[i].as_py(), np.int64)
                for part in b.column(11)[i].as_py() or ():
                    x = np.frombuffer(part["n"], np.int64)
                    n[part["lo"] : part["lo"] + len(x)], best[part["lo"] : part["lo"] + len(x)] = x, np.frombuffer(part["best"], bool)
                sums = []
                for per_pair in (best, n):
                    per_unit = np.diff(np.concatenate(([0], np.cumsum(per_pair[unit_pairs])))[np.concatenate(([0], unit_ends))])
                    sums.append(np.diff(np.concatenate(([0], np.cumsum(per_unit[seq])))[np.concatenate(([0], ends))]))
                yield pa.RecordBatch.from_arrays([ids, n_a, n_b, groups, groups, pa.array(sums[0]), pa.array(sums[1]), shas], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    scored = links.drop("stripes").join(by_key(back), "chunk", "left")
    return scored.transform(python_map, score, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
