"""N-gram Jaccard join: a prefix-tree join over globally ordered shingle sets.

All sets are in one global order: shingles by how many documents hold them, rare ones first
(the most frequent are counted over the corpus and kept in a table of bounded size; others
are equal, then by hash).  Two sets that are similar enough share a shingle in the first
quarter of both.  So sets meet on the shingles of their beginnings; what occurs in one set
alone is gone in the packed exchange before it becomes a row.

Candidates are verified in prefix trees: the sets that one set is to be compared with are
stored in a trie in the global order, and a traversal counts the overlap of a shared path
once, and leaves a subtree as soon as what remains on either side cannot reach the
similarity.  Whole sets are compared, so links are exact.

A group that shares a shingle is not expanded into all pairs, unless it is small (eight sets).  Of a
large group each set first meets the group's first set, in tries in which the candidates are also
linked to each other; these links make components.  Then sets of different components of a group
meet, and of these only pairs that two bounds leave possible become candidates.  Sets that share no shingle of a small
group share at most as many of their beginnings as either has in large groups; pairs for which that is too little do
not meet here nor with first sets, so texts with a passage or two in common are no candidates, and elements are made
of candidates alone.  Parities: a set's shingles fall into 512 cells, a bit for each says whether their number is odd,
and an element of one set alone changes one bit, so sets differ in at least as many elements as in bits.  Nothing
similar is lost; pages that have a template passage or two in common differ in far more bits than similar ones may, up
to some 800 shingles (of longer sets most bits are as if drawn, and fewer pairs are told apart).  The pairs of a group
are compared within the join, a few words each, and only candidates leave it.  Equal sets (copies) take part once.

All links of a document are counted, where asked for, once components are known: similar sets are in one,
so its sets probe tries of each other, block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexloom.llm.components import components
from indexloom.llm.packed import bucket_of, by_bucket, chunks, layout, reduce_buckets
from indexloom.llm.scratch import Scratch, by_key, columns, number, numbered
from indexloom.llm.text import mix, shingles
from indexloom.llm.workers import python_map

#: Words of a shingle; similarity as a fraction.
K, NUM, DEN = 5, 75, 100
#: Entries of the table of frequent shingles at most, and documents from which one may be frequent.
FREQUENT, OFTEN = 1 << 18, 8
#: Members of a group whose pairs are counted one by one.
SMALL = 8
#: Words of 64 bits of a set's parities.
PARITY = 8
#: Sets and elements of a trie, about; more are dealt over several tries.
TRIE, ELEMENTS = 256, 1 << 20


def need(a: int | np.ndarray, b: int | np.ndarray, num: int = NUM, den: int = DEN) -> int | np.ndarray:
    """Smallest overlap of sets of a and b elements that makes them similar."""
    return -(-num * (a + b) // (num + den))


class Trie:
    """Sorted sets as a prefix tree: a node is a range of the sorted list that shares its first ``depth`` elements."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())
        self.sets = [sets[i].view(">u8").astype(np.uint64) for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)

    def overlaps(self, probe: np.ndarray, num: int = NUM, den: int = DEN) -> list[tuple[int, int]]:
        """(index of the set, overlap) of every set that is similar to ``probe`` (sorted, same order)."""
        n, found = len(probe), []
        todo = [(0, len(self.sets), 0, 0)] if self.sets else []
        while todo:
            lo, hi, depth, seen = todo.pop()
            first, last = self.sets[lo], self.sets[hi - 1]
            # the edge: as far as all sets of the range agree
            m = min(len(first), len(last))
            same = first[depth:m] == last[depth:m]
            end = depth + (int(np.argmin(same)) if not same.all() else len(same))
            edge = first[depth:end]
            at = np.searchsorted(probe, edge)
            seen += int(np.count_nonzero(probe[np.minimum(at, n - 1)] == edge))
            # what remains on either side
            left = n - (int(np.searchsorted(probe, edge[-1], "right")) if len(edge) else int(np.searchsorted(probe, first[end - 1], "right")) if end else 0)
            sizes = self.sizes[lo:hi]
            possible = seen + np.minimum(left, sizes - end) >= need(n, sizes, num, den)
            if not possible.any():
                continue
            while lo < hi and self.sizes[lo] == end:  # sets that end here
                if possible[0] and seen >= need(n, end, num, den):
                    found.append((self.order[lo], seen))
                lo, possible = lo + 1, possible[1:]
            if lo == hi:
                continue
            heads = np.array([s[end] for s in self.sets[lo:hi]], np.uint64)
            cuts = np.concatenate(([0], np.flatnonzero(heads[1:] != heads[:-1]) + 1, [hi - lo]))
            todo.extend((lo + a, lo + b, end, seen) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if possible[a:b].any())
        return found


def _key(s: np.ndarray) -> np.ndarray:
    """A sorted set as big-endian numbers, so that bytes sort as the numbers do."""
    return s.astype(">u8")


def frequent(docs: DataFrame, scratch: Scratch, k: int, most: int = FREQUENT, often: int = OFTEN) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent 32-bit cells of shingle hashes over all documents (sorted), and the class of each.

    A class is the binary logarithm of the number of documents.  At most ``most`` cells: beyond that
    the rarest class goes, which changes the order of the sets but no result.
    """
    dealt = layout(docs)
    buckets = dealt.buckets

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, size=dealt.chunk):
            sets = [(shingles(t, k) >> np.uint64(32)).astype(np.uint32) for t in c["text"]]
            cells, n = np.unique(np.concatenate(sets), return_counts=True)
            rows = [(b, cells[at].tobytes(), n[at].astype(np.uint32)[n[at] > 1].tobytes(), np.flatnonzero(n[at] > 1).astype(np.uint32).tobytes()) for b, at in by_bucket(bucket_of(cells.astype(np.uint64) << np.uint64(32), buckets))]
            yield _rows(rows, "bucket int, cells binary, more binary, place binary")

    def add(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        cells, counts = [], []
        for r in rows:
            x = np.frombuffer(r["cells"], np.uint32)
            n = np.ones(len(x), np.int64)
            n[np.frombuffer(r["place"], np.uint32)] = np.frombuffer(r["more"], np.uint32)
            cells.append(x)
            counts.append(n)
        x, n = np.concatenate(cells), np.concatenate(counts)
        order = np.argsort(x, kind="stable")
        x, n = x[order], n[order]
        start = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        sums = np.add.reduceat(n, start)
        hit = sums >= often
        yield _rows(list(zip(x[start][hit].astype(np.int64).tolist(), np.log2(sums[hit]).astype(int).tolist(), strict=True)), "cell long, class int")

    packed = docs.select("text").transform(python_map, count, "bucket int, cells binary, more binary, place binary")
    sums = scratch.cut(reduce_buckets(packed, dealt.tasks, add, "cell long, class int"), "frequent")
    by_class = {r["class"]: r["n"] for r in sums.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}  # 64 rows at most
    least, total = 99, 0
    for c in sorted(by_class, reverse=True):
        total += by_class[c]
        if total > most:
            break
        least = c
    rows = sorted((r["cell"], r["class"]) for r in sums.where(F.col("class") >= least).collect())  # ``most`` rows at most
    scratch.drop(sums)
    return np.array([r[0] for r in rows], np.uint32), np.array([r[1] for r in rows], np.uint8)


_FIELDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _rows(rows: list[tuple], fields: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in fields.split(", ")), strict=True)
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _FIELDS[t]) for c, t in zip(cols, kinds, strict=True)], list(names))


def ordered(s: np.ndarray, cells: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A set's shingles as ranks in the global order: the class in the top byte, then the hash; sorted."""
    if len(cells):
        cell = (s >> np.uint64(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
        level = np.where(cells[at] == cell, classes[at], 0).astype(np.uint64)
    else:
        level = np.zeros(len(s), np.uint64)
    return np.sort(level << np.uint64(56) | s >> np.uint64(8))


def parities(s: np.ndarray) -> np.ndarray:
    """Whether an odd number of the set's elements falls into each of 64 * ``PARITY`` cells, as bits of numbers."""
    odd = np.bincount((mix(s) & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


_BITS = [f"s{i}" for i in range(PARITY)]


def differing(one: str, two: str) -> Column:
    """In how many bits the parities in the columns ``one``0, ``one``1, ... and ``two``0, ... differ."""
    return reduce(lambda a, b: a + b, (F.bit_count(F.col(f"{one}{i}").bitwiseXOR(F.col(f"{two}{i}"))) for i in range(PARITY)))


_SLIM = "kind int, _uid long, other long, token long, n int, digest binary, last long, posted boolean, place int, " + ", ".join(f"{b} long" for b in _BITS) + ", bucket int, payload binary"


def beginnings(docs: DataFrame, scratch: Scratch, k: int, num: int, den: int, shared) -> DataFrame:  # noqa: ANN001  a broadcast
    """What the beginnings of the sets have in common, as rows of three kinds.

    0: _uid, n, digest, last (rank of the beginning's end), posted (the first of equal sets of its chunk), parities s0, s1, ... where posted.
    1: _uid, other: two sets of a small group, whose sizes allow the similarity, once for each shingle they share;
    posted: whether it can be the first that similar sets of their sizes share.
    2: _uid, n, token, place: the members of a group of more than ``SMALL`` sets; place: the token's in the set.
    """
    dealt = layout(docs)
    buckets = dealt.buckets

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, classes = shared.value
        none = (None,) * PARITY
        for c in chunks(batches, size=dealt.chunk):
            slim, tokens, owners, sizes, places, known = [], [], [], [], [], set()
            for u, t in zip(c["_uid"], c["text"], strict=True):
                s = shingles(t, k)
                n = len(s)
                if not n:
                    slim.append((0, u, None, None, 0, b"", 0, False, None, *none))
                    continue
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                rank = ordered(s, cells, classes)
                p = n - -(-num * n // den) + 1
                slim.append((0, u, None, None, n, digest, int(rank[p - 1].astype(np.int64)), digest not in known, None, *(none if digest in known else parities(rank).tolist())))
                if digest not in known:  # equal sets of a chunk take part once
                    known.add(digest)
                    tokens.append(rank[:p])
                    owners.append(np.full(p, u, np.int64))
                    sizes.append(np.full(p, n, np.int32))
                    places.append(np.arange(p, dtype=np.int32))
            where = bucket_of(mix(np.array([r[1] for r in slim], np.int64).view(np.uint64)), buckets)
            rows = [(*r, int(b), None) for r, b in zip(slim, where.tolist(), strict=True)]
            if tokens:
                x, u, n, at0 = map(np.concatenate, (tokens, owners, sizes, places))
                rows += [(3, None, None, None, None, None, None, None, None, *none, b, x[at].tobytes() + u[at].tobytes() + n[at].tobytes() + at0[at].tobytes()) for b, at in by_bucket(bucket_of(mix(x), buckets))]
            for lo in range(0, len(rows), 4096):
                yield _rows(rows[lo : lo + 4096], _SLIM)

    def meet(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        plain = [tuple(r.values()) for r in rows if not r["kind"]]
        if plain:
            yield _rows(plain, _SLIM)
        xs, us, ns, ps = [], [], [], []
        for p in (r["payload"] for r in rows if r["kind"]):
            m = len(p) // 24
            xs.append(np.frombuffer(p, np.uint64, m))
            us.append(np.frombuffer(p, np.int64, m, 8 * m))
            ns.append(np.frombuffer(p, np.int32, m, 16 * m))
            ps.append(np.frombuffer(p, np.int32, m, 20 * m))
        if not xs:
            return
        x, u, n, place = map(np.concatenate, (xs, us, ns, ps))
        order = np.argsort(x, kind="stable")
        x, u, n, place = x[order], u[order], n[order].astype(np.int64), place[order]
        start = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        size = np.diff(np.append(start, len(x)))
        # small groups: all their pairs, by distance within the sorted list
        one, two, hit = [], [], []
        for step in range(1, SMALL):
            first = np.repeat(start[(size > step) & (size <= SMALL)], size[(size > step) & (size <= SMALL)] - step)
            if not len(first):
                break
            count = size[(size > step) & (size <= SMALL)] - step
            i = first + np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
            j = i + step
            ok = (n[i] * den >= n[j] * num) & (n[j] * den >= n[i] * num)
            one.append(np.minimum(u[i], u[j])[ok])
            two.append(np.maximum(u[i], u[j])[ok])
            most = need(n[i], n[j], num, den)
            hit.append(((place[i] <= n[i] - most) & (place[j] <= n[j] - most))[ok])
        if one:
            yield from _sparse(1, {"_uid": np.concatenate(one), "other": np.concatenate(two), "posted": np.concatenate(hit)})
        large = np.repeat(size > SMALL, size)
        if large.any():
            yield from _sparse(2, {"_uid": u[large], "token": x[large].view(np.int64), "n": n[large].astype(np.int32), "place": place[large]})

    packed = docs.select("_uid", "text").transform(python_map, begin, _SLIM)
    return scratch.cut(reduce_buckets(packed, dealt.tasks, meet, _SLIM).drop("bucket", "payload"), "beginnings")


def _sparse(kind: int, given: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_SLIM`` with only some columns filled."""
    total = len(next(iter(given.values())))
    for lo in range(0, total, 1 << 16):
        m = min(1 << 16, total - lo)
        cols = []
        for name, t in (f.split() for f in _SLIM.split(", ")):
            cols.append(pa.array(given[name][lo : lo + m], _FIELDS[t]) if name in given else pa.array(np.full(m, kind, np.int32)) if name == "kind" else pa.nulls(m, _FIELDS[t]))
        yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in _SLIM.split(", ")])


def linked(sets: list[np.ndarray], num: int = NUM, den: int = DEN) -> list[tuple[int, int, int]]:
    """(i, j, overlap): links that connect the sets as all their links would.

    From one set to those similar to it, from these on to those not reached yet, and so on, then from the
    next set; the trie holds what is not reached.
    """
    rest, out, start = set(range(len(sets))), [], 0
    while start < len(sets):
        if start not in rest:
            start += 1
            continue
        rest.discard(start)
        todo = [start]
        held, trie = sorted(rest), None
        while todo and rest:
            if trie is None or len(rest) * 2 < len(held):
                held = sorted(rest)
                trie = Trie([sets[i] for i in held])
            probe = todo.pop()
            for at, overlap in trie.overlaps(sets[probe].view(">u8").astype(np.uint64), num, den):
                i = held[at]
                if i in rest:
                    rest.discard(i)
                    todo.append(i)
                    out.append((probe, i, overlap))
        start += 1
    return out


def element_sets(nodes: DataFrame, docs: DataFrame, scratch: Scratch, k: int, shared) -> DataFrame:  # noqa: ANN001
    """(_uid, n, elements) of the documents in ``nodes``, made anew from their texts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, classes = shared.value
        for b in batches:
            ranks = [ordered(shingles(t, k), cells, classes) for t in b.column(1).cast(pa.binary()).to_pylist()]
            made = [b.column(0), pa.array([len(r) for r in ranks], pa.int64()), pa.array([_key(r).tobytes() for r in ranks], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, ["_uid", "n", "elements"])

    return scratch.cut(docs.join(by_key(nodes), "_uid", "left_semi").select("_uid", "text").transform(python_map, make, "_uid long, n long, elements binary"), "sets", "none")


def verified(pairs: DataFrame, sets: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """Links (a, b, overlap) that connect what the similar ones among candidate ``pairs`` (a, b) connect.

    The candidates of one a are dealt into tries of bounded numbers and bytes, each with a, so an a
    with very many candidates is many small tasks; within a trie also candidates are linked to each other.
    """
    spark = pairs.sparkSession
    loads = pairs.join(sets.select(F.col("_uid").alias("b"), "n"), "b").groupBy("a").agg(F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(TRIE), F.sum("n") / F.lit(ELEMENTS))).cast("int").alias("parts"))
    dealt = pairs.select("a", "b").join(loads, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    members = dealt.unionByName(dealt.select("a", "part", F.col("a").alias("b")).distinct())
    rows = members.join(sets.select(F.col("_uid").alias("b"), "elements"), "b").select("a", "part", "b", "elements")
    groups = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a", "part").sortWithinPartitions("a", "part", "b")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def links() -> pa.RecordBatch:
            ids = [r[2] for r in held]
            return _rows([(ids[i], ids[j], o) for i, j, o in linked([np.frombuffer(r[3], np.uint8).view(">u8") for r in held], num, den)], "a long, b long, overlap long")

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and r[:2] != held[0][:2]:
                    yield links()
                    held = []
                held.append(r)
        if held:
            yield links()

    return scratch.cut(groups.transform(python_map, walk, "a long, b long, overlap long"), "links")


def counted(roots: DataFrame, weights: DataFrame, sets: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """(_uid, similar): how many documents of other sets are similar to each set that has links.

    Similar sets are in one component.  The sets of a component are dealt into blocks of about ``TRIE``, and every two
    blocks are a task: the sets of one probe a trie of the other, and counts leave it, not pairs.  ``weights``: (_uid, m),
    the documents of a set.
    """
    spark = roots.sparkSession
    members = roots.select(F.col("node").alias("_uid"), "root").unionByName(roots.select(F.col("root").alias("_uid"), "root").distinct())
    members = members.join(weights, "_uid").join(sets.select("_uid", F.col("n").alias("elems")), "_uid")
    loads = members.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(TRIE), F.sum("elems") / F.lit(ELEMENTS))).cast("int").alias("parts"))
    dealt = members.join(loads, "root").withColumn("part", F.pmod(F.xxhash64("_uid"), F.col("parts")).cast("int"))
    # a set goes to as many tasks as its component has blocks
    dealt = dealt.select("_uid", "root", "m", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("root", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), (F.col("part") > F.col("other")).alias("probe"), "_uid", "m")
    rows = dealt.join(sets.select("_uid", "elements"), "_uid").select("root", "p", "q", "probe", "_uid", "m", "elements")
    groups = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "root", "p", "q").sortWithinPartitions("root", "p", "q", "probe", "_uid")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def counts() -> pa.RecordBatch:
            same = held[0][1] == held[0][2]
            stored = [i for i, r in enumerate(held) if same or not r[3]]
            sets = [np.frombuffer(r[6], np.uint8).view(">u8") for r in held]
            trie, found = Trie([sets[i] for i in stored]), np.zeros(len(held), np.int64)
            for i, r in enumerate(held):
                if same or r[3]:
                    for at, _ in trie.overlaps(sets[i].astype(np.uint64), num, den):
                        j = stored[at]
                        if i != j:
                            found[i] += held[j][5]
                            found[j] += 0 if same else r[5]
            return _rows([(r[4], int(f)) for r, f in zip(held, found, strict=True) if f], "_uid long, similar long")

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and r[:3] != held[0][:3]:
                    yield counts()
                    held = []
                held.append(r)
        if held:
            yield counts()

    return scratch.cut(groups.transform(python_map, walk, "_uid long, similar long").groupBy("_uid").agg(F.sum("similar").alias("similar")), "counts")


def _needed(n: Column, m: Column, num: int, den: int) -> Column:
    """Smallest overlap of sets of n and m elements that makes them similar."""
    return F.floor((num * (n + m) + (num + den - 1)) / F.lit(num + den)).cast("long")


def _bound(n: str, last: str, m: str, end: str, num: int, den: int) -> tuple[Column, Column]:
    """The overlap that two sets need, and how much of it can lie behind the shorter of their beginnings."""

    def behind(x: str) -> Column:
        return F.expr(f"({num} * {x} + {den - 1}) div {den} - 1")

    must = F.expr(f"({num} * ({n} + {m}) + {num + den - 1}) div {num + den}")
    return must, F.when(F.col(last) <= F.col(end), behind(n)).otherwise(behind(m))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, num: int = NUM, den: int = DEN, uid: str | None = None, count_links: bool = False) -> dict[str, DataFrame]:
    """Links every two documents whose shingle sets have at least num/den of their union in common.

    Returns ``documents`` (_uid, doc_id, n_shingles, component_id, first: whether the row stands for its
    component) and ``links`` (a, b, overlap: links between numbers (_uid) of different sets, enough to connect
    the components; copies are not expanded).  With ``count_links`` documents have ``n_links`` too, the number of all
    other documents that are similar, copies among them.  ``uid`` names a column of a stored table that numbers its rows;
    without it rows are numbered here.  Null or empty texts have no shingles and no links; a null id
    counts as larger than others; repeated rows are linked as copies; a text of any length is shingled whole, in
    segments; an empty table gives empty results; other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    base = docs.select(number(uid).alias("_uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = base if uid else scratch.cut(base, "base")  # rows with numbers of their own are stored already
    shared = spark.sparkContext.broadcast(frequent(base, scratch, k))  # FREQUENT entries at most
    scratch.release()
    both = beginnings(base, scratch, k, num, den, shared)
    scratch.release()
    slim = both.where("kind = 0").select("_uid", "n", "digest", "last", "posted")
    rep = both.where("kind = 0 and posted").groupBy("digest").agg(F.min(F.struct("_uid", "n", "last", *_BITS)).alias("r")).select("digest", F.col("r._uid").alias("rep"), *(F.col(f"r.{x}").alias(x) for x in ("n", "last", *_BITS)))
    rep = scratch.cut(rep, "representatives")
    large = both.where("kind = 2").select("_uid", F.col("n").cast("long").alias("n"), "token", "place").join(rep.select(F.col("rep").alias("_uid")), "_uid")
    large = scratch.cut(large, "large")
    loads = large.groupBy("_uid").agg(F.count(F.lit(1)).alias("l"))

    # small groups: pairs whose shared shingles, with all that could be shared in large groups and behind the
    # beginnings, are enough
    met = both.where("kind = 1").groupBy(F.col("_uid").alias("a"), F.col("other").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.max("posted").alias("hit"))
    side = rep.select(F.col("rep").alias("_uid"), F.col("n").cast("long").alias("n"), "last", *_BITS).join(loads, "_uid", "left").withColumn("l", F.coalesce("l", F.lit(0)))
    side = scratch.cut(side, "sides")
    plain = side.select("_uid", "n", "last", "l")

    def sided(found: DataFrame) -> DataFrame:
        return found.join(plain.toDF("b", "bn", "bl", "bh"), "b").join(plain.toDF("a", "an", "al", "ah"), "a")

    met = sided(met)
    must, behind = _bound("an", "al", "bn", "bl", num, den)
    shared_large = F.least("ah", "bh")
    close = met.where((F.col("hit") | (shared_large > 0)) & (F.col("c") + shared_large + behind >= must)).select("a", "b")

    # large groups: each set meets the first set of its groups, the one it meets most often of those that it may be similar
    # to by shingles of large groups alone (with others of small groups the two have met above)
    hubs = large.groupBy("token").agg(F.min("_uid").alias("h"))
    star = large.join(hubs, "token").where("_uid <> h").groupBy(F.col("_uid").alias("b"), F.col("h").alias("a")).agg(F.count(F.lit(1)).alias("c"))
    star = sided(star).where((F.col("an") * den >= F.col("bn") * num) & (F.col("bn") * den >= F.col("an") * num) & (shared_large + behind >= must))
    star = star.groupBy("b").agg(F.max(F.struct("c", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
    pairs = scratch.cut(close.unionByName(star).distinct(), "candidates")
    made = [element_sets(pairs.select(F.col("a").alias("_uid")).union(pairs.select("b")).distinct(), base, scratch, k, shared)]
    sets = made[0]
    scratch.release()
    first = verified(pairs, sets, scratch, num, den)
    roots = components(first, scratch)

    # sets of different components of a large group meet, at a shingle that can be the first they share, and
    # are candidates if their parities differ in no more bits than similar sets may in elements
    where = large.join(roots.select(F.col("node").alias("_uid"), "root"), "_uid", "left").withColumn("root", F.coalesce("root", "_uid"))
    least = large.groupBy("token").agg(F.min("n").alias("least"))
    smallest = F.greatest(F.col("least"), F.expr(f"({num} * n + {den - 1}) div {den}"))
    where = scratch.cut(where.join(least, "token").where(F.col("place") <= F.col("n") - _needed(F.col("n"), smallest, num, den)).drop("least"), "placed")
    sizes = where.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c"))
    major = sizes.groupBy("token").agg(F.max(F.struct("c", "root")).alias("m"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("token", F.col("m.root").alias("major"))
    mixed = where.join(major, "token").join(by_key(side.drop("n")), "_uid")
    x = mixed.where("root <> major").select("token", F.col("_uid").alias("xu"), F.col("n").alias("xn"), F.col("place").alias("xp"), F.col("root").alias("xr"), F.col("last").alias("xe"), F.col("l").alias("xl"), *(F.col(b).alias(f"x{b}") for b in _BITS))
    y = mixed.select("token", F.col("_uid").alias("yu"), F.col("n").alias("yn"), F.col("place").alias("yp"), F.col("root").alias("yr"), (F.col("root") == F.col("major")).alias("ym"), F.col("last").alias("ye"), F.col("l").alias("yl"), *(F.col(b).alias(f"y{b}") for b in _BITS))
    must = _needed(F.col("xn"), F.col("yn"), num, den)
    near = (F.col("xn") * den >= F.col("yn") * num) & (F.col("yn") * den >= F.col("xn") * num) & (F.col("xp") <= F.col("xn") - must) & (F.col("yp") <= F.col("yn") - must)
    needed, behind = _bound("xn", "xe", "yn", "ye", num, den)
    near = near & (F.least("xl", "yl") + behind >= needed) & (differing("xs", "ys") <= F.col("xn") + F.col("yn") - 2 * must)
    cross = x.join(y, "token").where((F.col("xr") != F.col("yr")) & (F.col("ym") | (F.col("xu") < F.col("yu"))) & near)
    crossing = scratch.cut(cross.select(F.least("xu", "yu").alias("a"), F.greatest("xu", "yu").alias("b")).distinct(), "crossing")
    links = first
    if not crossing.isEmpty():
        rest = crossing.select(F.col("a").alias("_uid")).union(crossing.select("b")).distinct().join(by_key(sets.select("_uid")), "_uid", "left_anti")
        made.append(element_sets(rest, base, scratch, k, shared))
        sets = sets.unionByName(made[1])
        scratch.release()
        links = first.unionByName(verified(crossing, sets, scratch, num, den))
        roots = components(links.select("a", "b"), scratch)

    if count_links:
        copies = rep.select("digest", F.col("rep").alias("_uid")).join(slim.where("n > 0").groupBy("digest").agg(F.count(F.lit(1)).alias("m")), "digest").select("_uid", "m")
        copies = scratch.cut(copies, "copies")
        similar = copies.join(counted(roots, copies, sets, scratch, num, den), "_uid", "left").select(F.col("_uid").alias("rep"), (F.col("m") - 1 + F.coalesce("similar", F.lit(0))).alias("n_links"))
        scratch.release()
    placed = slim.join(rep.select("digest", "rep"), "digest", "left").select("_uid", "n", F.coalesce("rep", "_uid").alias("rep"))
    if count_links:
        placed = placed.join(similar, "rep", "left")
    placed = placed.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("_uid", "n", F.coalesce("root", "rep").alias("root"), *([F.coalesce("n_links", F.lit(0)).alias("n_links")] if count_links else []))
    ids = scratch.cut(placed.join(base.select("_uid", "doc_id"), "_uid"), "components")
    least = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_uid")).alias("_f"))
    least = scratch.cut(least, "least")  # so that the join has plain exchanges, which are split where a component is large
    out = ids.join(least, "root").select("_uid", F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id", (F.col("_uid") == F.col("_f._uid")).alias("first"), *(["n_links"] if count_links else []))
    scratch.drop(*made)
    return {"documents": out, "links": links}


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """Of each component the row with the smallest id, with the columns of ``docs``, whatever these are named.

    Rows without shingles (null, empty) all stay, and of rows with equal id and text one.
    """
    scratch = Scratch(docs.sparkSession)
    rows, uid = numbered(docs, scratch)
    kept = jaccard_join(rows, id_col, text_col, k, num, den, uid)["documents"].where("first").select(F.col("_uid").alias(uid))
    return rows.join(by_key(kept), uid, "left_semi").select(columns(docs))
