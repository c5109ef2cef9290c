"""Removal of repeated bytes by suffix sorting, against brute force."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from indexloom.llm import packed, suffixes
from tests.llm import cases


def plain(rows, span=100):
    """rows: doc_id, text, in order; among equal ids any order may be taken, so this is for distinct ones."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - span + 1):
            g = b[k : k + span]
            if g in seen:
                gone[k : k + span] = True
            seen.add(g)
        edge = np.diff(np.concatenate(([0], gone.astype(int))))
        out.append((i, len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


@given(st.lists(st.tuples(st.text("ab\x00", max_size=40), st.integers(0, 3)), max_size=40), st.sampled_from([0, 8, 24]))
@settings(max_examples=300, deadline=None)
def test_order(found, shallow):
    """Like a sort of strings, whichever part of it the blind tries do."""
    texts = [(t * (1 + 3 * k))[:100].encode() for t, k in found]
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    order, differs = suffixes.deep_shallow(suffixes.Suffixes(data, np.cumsum(sizes) - sizes, sizes), shallow)
    got = [texts[i] for i in order]
    assert got == sorted(texts, key=lambda t: (len(t), t))
    assert differs.tolist() == [k == 0 or got[k] != got[k - 1] for k in range(len(got))]


def test_order_of_long_prefixes():
    r = random.Random(3)
    stem = bytes(r.randrange(256) for _ in range(90))
    texts = [stem[: r.randrange(20, 90)] + bytes(r.choice(b"xyz") for _ in range(90)) for _ in range(3000)]
    texts = [t[:100] for t in texts] * 2
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.full(len(texts), 100)
    order, differs = suffixes.deep_shallow(suffixes.Suffixes(data, np.cumsum(sizes) - sizes, sizes))
    assert [texts[i] for i in order] == sorted(texts)
    assert differs.sum() == len(set(texts))


def repeated(seed, n=60):
    """Texts with passages in common, cut anywhere, in several alphabets; a long one that repeats itself."""
    r = random.Random(seed)
    pool = ["".join(r.choice(a) for _ in range(r.randint(80, 260))) for a in ("abc ", "äöü中 x", "0123456789 abcdefghij") for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(r.randint(0, 6)):
            p = r.choice(pool)
            lo = r.randrange(len(p))
            parts.append(r.choice([p, p, p[lo:], p[: lo + 1], p.replace(p[lo], "#", 1), "-" * r.randint(0, 12)]))
        texts.append("".join(parts))
    return [*enumerate(texts), (500, "z" * 4000), (501, None), (502, ""), (-5, "".join(pool[:3]) * 9), (None, pool[0] + pool[1]), (503, pool[5]), (504, pool[5])]


def test_dedup(spark):
    rows = repeated(1)
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, chunk int, ends string, marks string").repartition(5)
    assert rows_of(suffixes.dedup_bytes(docs)) == plain(rows)
    assert suffixes.dedup_bytes(docs.where("false")).count() == 0
    kept = suffixes.dedup_bytes(docs, with_kept=True).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in kept)


def test_dedup_in_parts(spark, monkeypatch):
    """Small chunks and segments, a few strings sorted at a time."""
    for where, name, value in ((suffixes, "SEGMENT", 333), (suffixes, "SORTED", 50), (packed, "CHUNK", 700), (packed, "ROW", 0)):
        monkeypatch.setattr(where, name, value)
    rows = repeated(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(suffixes.dedup_bytes(docs)) == plain(rows)


def test_awkward_rows(spark):
    """Repeated ids: one of the equal rows keeps its bytes."""
    rows = [(r[0], r[1]) for r in cases.rows()]
    got = rows_of(suffixes.dedup_bytes(cases.documents(spark)))
    assert sorted((r[0], r[1]) for r in got if r[0] is not None) == sorted((i, len((t or "").encode())) for i, t in rows if i is not None)
    assert len(got) == len(rows)
    same = spark.createDataFrame([(1, "q" * 60 + "r" * 60)] * 3 + [(None, "q" * 60 + "r" * 60)] * 2, "doc_id long, text string")
    assert sorted(r[2] for r in rows_of(suffixes.dedup_bytes(same))) == [0, 120, 120, 120, 120]
    assert [r[2] for r in rows_of(suffixes.dedup_bytes(same)) if r[0] is None] == [120, 120]
