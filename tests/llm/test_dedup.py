"""Exact dedup, n-gram join, substring and line dedup against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from indexloom.llm import exact_dedup, line_dedup, ngram_join, substring
from indexloom.llm.components import components
from indexloom.llm.scratch import Scratch
from indexloom.llm.text import Words, shingles
from tests.llm import cases


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark)


@pytest.fixture(scope="module")
def many(spark):
    """Random near copies around a few texts, one large group of copies, shared passages."""
    rnd = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = rnd.choices(vocabulary, k=26)
    out, i = [], 0
    for _ in range(12):
        text = rnd.choices(vocabulary, k=rnd.randint(5, 120))
        for _ in range(rnd.choice([1, 2, 12, 30])):
            t = list(text)
            for _ in range(rnd.randint(0, 3)):
                t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
            if rnd.random() < 0.3:
                at = rnd.randrange(len(t))
                t[at:at] = passage
            out.append((i, " ".join(t)))
            i += 1
    out += [(i + k, "the same old text again and again") for k in range(40)]
    rnd.shuffle(out)
    return spark.createDataFrame(out, "doc_id long, text string")


@pytest.mark.parametrize("block", [exact_dedup.BLOCK, 7])
def test_exact(docs, block):
    got = exact_dedup.exact_dedup(docs, block=block).collect()
    assert cases.key((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == cases.key(cases.exact(pairs(docs)))
    groups = {}
    for r in got:
        groups.setdefault(r.text_sha256, []).append(r)
    assert all(sum(r.kept for r in g) == 1 for g in groups.values())
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_long_text(spark):
    """A text of 16 MB is cut in one pass."""
    import time

    long = "".join(f"{i} w" for i in range(2_000_000))
    start = time.monotonic()
    got = exact_dedup.exact_dedup(spark.createDataFrame([(1, long), (2, long + "x"), (3, long.replace(" ", "\n"))], "doc_id long, text string")).collect()
    assert time.monotonic() - start < 120
    assert cases.key((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == cases.key(cases.exact([(1, long), (2, long + "x"), (3, long)]))


def test_exact_shared_hashes(spark, monkeypatch, docs):
    """Blocks whose hashes agree are told apart by content."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.hash(*c).cast("long") % 3)
    got = exact_dedup.exact_dedup(docs, block=50).collect()
    assert cases.key((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == cases.key(cases.exact(pairs(docs)))


def test_exact_keeps_columns(docs):
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({x[3] for x in cases.exact(pairs(docs))})


def test_ngram(docs):
    got = ngram_join.jaccard_join(docs)["documents"].collect()
    assert cases.key((r.doc_id, r.n_shingles, r.component_id) for r in got) == cases.key(cases.jaccard(pairs(docs)))


@pytest.mark.parametrize("small", [8, 2])
def test_ngram_groups(many, monkeypatch, small):
    """Large groups too: hubs, tries and crossing pairs."""
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "TRIE", 16)
    got = ngram_join.jaccard_join(many)["documents"].collect()
    assert cases.key((r.doc_id, r.n_shingles, r.component_id) for r in got) == cases.key(cases.jaccard(pairs(many)))


@pytest.mark.parametrize("trie", [256, 4])
def test_ngram_counts_links(many, monkeypatch, trie):
    """Every link of a document is counted, in large groups too."""
    monkeypatch.setattr(ngram_join, "TRIE", trie)
    sets = [(i, frozenset(shingles(t.encode(), ngram_join.K).tolist())) for i, t in pairs(many)]
    want = {i: sum(100 * len(s & x) >= 75 * len(s | x) for j, x in sets if j != i and s) for i, s in sets}
    got = {r.doc_id: r.n_links for r in ngram_join.jaccard_join(many, count_links=True)["documents"].collect()}
    assert got == want and max(want.values()) > 30


def test_ngram_keeps_one(docs):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    with_words = [x for x in cases.jaccard(pairs(docs)) if x[1]]
    without = sum(1 for x in cases.jaccard(pairs(docs)) if not x[1])
    assert kept.count() == len({x[2] for x in with_words}) + without


@given(st.lists(st.sets(st.integers(1, 40), min_size=1, max_size=25), min_size=1, max_size=12), st.sets(st.integers(1, 40), min_size=1, max_size=25))
@settings(max_examples=200, deadline=None)
def test_trie(sets, probe):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    trie = ngram_join.Trie([ngram_join._key(a) for a in arrays])
    got = sorted(trie.overlaps(np.array(sorted(probe), np.uint64)))
    assert got == [(i, len(s & probe)) for i, s in enumerate(sets) if 100 * len(s & probe) >= 75 * len(s | probe)]


@given(st.sets(st.integers(1, 1 << 60), max_size=60), st.sets(st.integers(1, 1 << 60), max_size=60), st.sets(st.integers(1, 1 << 60), max_size=300))
@settings(max_examples=200, deadline=None)
def test_parities_differ_at_most_as_sets_do(one, two, both):
    def bits(s):
        return ngram_join.parities(np.array(sorted(s), np.uint64)).view(np.uint64)

    differ = sum(int(x).bit_count() for x in bits(one | both) ^ bits(two | both))
    assert differ <= len((one | both) ^ (two | both))
    assert differ % 2 == len((one | both) ^ (two | both)) % 2


@pytest.mark.parametrize("pages", [200, 800])
def test_ngram_template_pages(spark, monkeypatch, pages):
    """Pages put together from common passages: nearly all share some, few are similar, and candidates stay in proportion."""
    rnd = random.Random(9)
    pool = [" ".join(f"p{i}w{rnd.randrange(10**6)}" for _ in range(40)) for i in range(60)]
    rows = [(i, " ".join(rnd.sample(pool, 6))) for i in range(pages)]
    rows += [(pages + i, rows[i][1] + " and a few more words") for i in range(0, pages, 10)]
    pairs_seen, verify = [], ngram_join.verified

    def verified(pairs, *rest):
        pairs_seen.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(ngram_join, "verified", verified)
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))["documents"].collect()
    assert {r.doc_id: r.component_id for r in got} == {x: x - pages if x >= pages else x for x, _ in rows}
    first, crossing = (pairs_seen + [0])[:2]  # within small groups, and with one of a large group; of different components
    assert first <= ngram_join.SMALL * len(rows) and crossing <= len(rows)


def test_ngram_makes_elements_of_candidates_alone(spark, monkeypatch):
    """Texts with a passage in common, among shingles that are not known as frequent: no sets are made of those that cannot be similar."""
    rnd = random.Random(4)
    passages = [" ".join(f"p{i}w{j}" for j in range(6)) for i in range(60)]
    rows = [(i, " ".join([*(f"d{i}w{j}" for j in range(40)), *rnd.sample(passages, 4)])) for i in range(400)]
    rows += [(400 + i, rows[i][1] + " few more") for i in range(0, 400, 40)]
    made, make = [], ngram_join.element_sets

    def element_sets(nodes, *rest):
        made.append(nodes.count())
        return make(nodes, *rest)

    monkeypatch.setattr(ngram_join, "element_sets", element_sets)
    monkeypatch.setattr(ngram_join, "frequent", lambda *_: (np.zeros(0, np.uint32), np.zeros(0, np.uint8)))
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), count_links=True)["documents"].collect()
    assert {r.doc_id: (r.component_id, r.n_links) for r in got} == {x: (x - 400 if x >= 400 else x, int(x >= 400 or x % 40 == 0)) for x, _ in rows}
    assert sum(made) <= len(rows) / 4


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_substrings(docs):
    got = substring.dedup_substrings(docs).collect()
    expected = cases.substrings(pairs(docs))
    assert cases.key((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == cases.key(expected)
    assert sum(x[2] for x in expected) > 100


def test_substrings_of_groups(many):
    got = substring.dedup_substrings(many, with_text=True).collect()
    assert cases.key((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == cases.key(cases.substrings(pairs(many)))
    assert all(cases.sha(r.kept) == r.kept_sha256 for r in got)


def test_windows_choose_anchors_by_content():
    w = Words((" ".join(f"w{i % 13}" for i in range(80))).encode())
    runs, at = substring.chosen(w, 20, 12)
    windows = w.runs(20)
    assert len(at) == len(windows)
    first = {}
    for h, s, a in zip(windows.tolist(), range(len(at)), at.tolist(), strict=True):
        assert s <= a <= s + 8
        assert first.setdefault(h, (a - s, runs[a])) == (a - s, runs[a])


def test_lines(docs):
    threshold = 2
    got = line_dedup.dedup_lines(docs, threshold=threshold).collect()
    sites = {}
    data = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    strip = " \t\n\x0b\x0c\r"
    for _, t, s in data:
        for line in (t or "").split("\n") if t is not None else []:
            if line.strip(strip):
                sites.setdefault(line.strip(strip), set()).add(s)
    expected = []
    for i, t, _ in data:
        lines = t.split("\n") if t is not None else []
        left = [x for x in lines if len(sites.get(x.strip(strip), ())) < threshold]
        expected.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    assert cases.key((r.doc_id, r.n_lines, r.n_removed, r.kept) for r in got) == cases.key(expected)
    assert any(x[2] for x in expected)


def test_lines_hot_and_cold(docs, monkeypatch):
    """Hot lines stay where they are, others meet by key; the result does not depend on where the limit is."""
    results = []
    for hot in (1, 8, line_dedup.HOT):  # all lines meet by key; some are hot; all that are shared are hot
        monkeypatch.setattr(line_dedup, "HOT", hot)
        results.append(cases.key(tuple(r)[1:] for r in line_dedup.dedup_lines(docs, threshold=2).collect()))
    assert results[0] == results[1] == results[2]



@given(st.text(alphabet="ab \t\n\x0b\x0c\rAß ", max_size=60), st.integers(1, 4))
@settings(max_examples=200, deadline=None)
def test_word_kernel(text, k):
    expected = cases.words(text)
    w = Words(text.encode())
    assert w.n == len(expected)
    assert w.join(np.ones(w.n, bool)).decode() == " ".join(expected)
    hashes = w.runs(k).tolist()
    same = {}
    for i, h in enumerate(hashes):
        assert same.setdefault(tuple(expected[i : i + k]), h) == h
    assert len(set(hashes)) == len(same)
    assert len(shingles(text.encode(), 5)) == len(cases.shingle_set(text))


def test_long_texts_are_hashed_in_segments(monkeypatch):
    from indexloom.llm import text

    rnd = random.Random(4)
    data = " ".join(rnd.choices(["a", "bb", "ccc"], k=3000)).encode()
    whole = Words(data).runs(7)
    monkeypatch.setattr(text, "SEGMENT", 100)
    assert (Words(data).runs(7) == whole).all()


def test_empty_tables(spark):
    none = cases.documents(spark, [])
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.keep_first(none).columns == none.columns
    assert ngram_join.jaccard_join(none)["documents"].count() == 0
    assert ngram_join.keep_one(none).count() == 0
    assert substring.dedup_substrings(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
