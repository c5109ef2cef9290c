"""Phrase mining and the alignment of two tokenizers, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from indexloom.llm import alignment, phrases
from tests.llm import cases

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SPACES = st.sampled_from([" ", "  ", "\n", " \n ", "\t", "\r\n", "\xa0", " 　 ", "\x0b", "\x1c", ""])
TEXTS = st.lists(st.tuples(SPACES, st.text(st.characters(exclude_categories=["Cs"]), max_size=8) | st.sampled_from(["don't", "<|endoftext|>", "<s>", "▁", "word", "é", "中文", "x;\r"])), max_size=12).map(lambda x: "".join(a + b for a, b in x))


@lru_cache
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_alignment(texts):
    """Per text: its groups as [(a ids, b ids)], by the libraries on whole texts."""
    tok, sp = libraries()
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in keep} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in keep)}
    out = []
    for t in texts:
        if not t:
            out.append([])
            continue
        goal = (" " + t).encode()
        a, b = tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
        ab = [bytes(byte[c] for c in tok.id_to_token(i)) for i in a]
        bb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(ab) != goal or b"".join(bb) != goal:
            out.append([])
            continue
        ea, eb = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            x, y = ea.index(end, i) + 1, eb.index(end, j) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        out.append(groups)
    return out


def expected_alignment(rows):
    found = plain_alignment([t for _, t in rows])
    count = Counter((g[0][-1], g[1][-1]) for groups in found for g in groups)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for (i, _), groups in zip(rows, found, strict=True):
        links = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def rows_of(df, columns="doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256"):
    return sorted(map(tuple, df.select(*columns.split()).collect()), key=repr)


@given(TEXTS)
@settings(max_examples=400, deadline=None)
def test_units_are_whole_texts(text):
    known = alignment.aligner(A, B)
    assert known.by_unit
    got = alignment._linked([1], [text.encode()], known)
    (want,) = expected_alignment([(1, text)])
    assert (got[1][0], got[2][0], got[3][0], got[4][0]) == (*want[1:4], want[-1])


def test_alignment(spark):
    docs = cases.documents(spark)
    assert rows_of(alignment.align(docs, A, B)) == sorted(expected_alignment([(r[0], r[1]) for r in cases.rows()]), key=repr)
    assert alignment.align(docs.where("false"), A, B).count() == 0
    dotted = docs.withColumnRenamed("text", "a.text").withColumnRenamed("doc_id", "an.id").withColumn("chunk", docs.size).withColumn("stripes", docs.n)
    assert rows_of(alignment.align(dotted, A, B, "an.id", "a.text")) == rows_of(alignment.align(docs, A, B))


def test_alignment_in_parts(spark, monkeypatch):
    """Small chunks, and stripes added in several parts."""
    from indexloom.llm import packed

    monkeypatch.setattr(packed, "CHUNK", 200)
    monkeypatch.setattr(packed, "ROW", 0)
    monkeypatch.setattr(alignment, "TASKS", 1)
    docs = cases.documents(spark).repartition(3, "doc_id")
    assert rows_of(alignment.align(docs, A, B)) == sorted(expected_alignment([(r[0], r[1]) for r in cases.rows()]), key=repr)


def test_alignment_rows_have_fixed_sizes(spark, monkeypatch):
    """Rows hold about a part's bytes of text, and which documents share one makes no difference."""
    from indexloom.llm.scratch import Scratch

    rows = [(i, " ".join(f"word{i % 7} w{i}x{j % 90}" for j in range(400)), "en") for i in range(300)]
    tables, cut = [], Scratch.cut

    def kept(self, df, *rest):
        tables.append(cut(self, df, *rest))
        return tables[-1]

    monkeypatch.setattr(Scratch, "cut", kept)
    monkeypatch.setattr(alignment, "PART", 1 << 16, raising=False)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    got = alignment.align(docs, A, B)
    links = next(t for t in tables if "unit_pairs" in t.columns)
    sizes = [r[0] for r in links.selectExpr("size(doc_id)").collect()]
    assert sum(sizes) == 300 and max(sizes) * min(len(t) for _, t, _ in rows) <= 1 << 17
    assert rows_of(got) == sorted(expected_alignment([(i, t) for i, t, _ in rows]), key=repr)


def test_alignment_of_many_units(spark):
    """A row with more units and pairs of ids than two bytes number."""
    rnd = random.Random(2)
    rows = [(i, " ".join(f"{rnd.randrange(16**6):06x}" for _ in range(n)), "en") for i, n in enumerate((70_000, 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = alignment.align(docs, A, B)
    assert rows_of(got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) == sorted(expected_alignment([(i, t) for i, t, _ in rows]), key=repr)


def test_alignment_query(spark):
    import __spark_entry__ as registry

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(registry.queries()["op12_token_alignment"](spark, sf)) == sorted(expected_alignment(rows), key=repr)


def plain_phrases(rows, longest, least, top):
    """rows: lang, text."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, longest + 1):
                    if i + k <= len(w):
                        f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        often = {g: a for g, a in counts.items() if a >= least}
        held = {g[i:j] for g, a in often.items() for i in range(len(g)) for j in range(i + 1, len(g) + 1) if j - i < len(g) and often[g[i:j]] == a}
        found = []
        for g, a in often.items():
            if len(g) > 1 and g not in held:
                score, _, left, right = min((1000 * a * n[lang] // (often[g[:k]] * often[g[k:]]), k, often[g[:k]], often[g[k:]]) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, g, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, g.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def phrase_rows(spark, rows, longest, least, top=2000):
    docs = spark.createDataFrame([(i, lang, text, 1, 2) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, chunk int, f int")
    return sorted(map(tuple, phrases.report(phrases.collocations(docs, longest=longest, least=least), top).collect()))


def awkward(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(6)] + ["The", "THE", "the", "Ünder", "a a", "a"]
    out = [(r.choice(["en", "de", None, "und"]), "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "\t", ". ", "\n", "\r", "  ", "! "]) for _ in range(r.randint(0, 40)))) for _ in range(n)]
    return [*out, ("en", None), ("en", ""), (None, None), ("de", ".,;"), ("en", "same words here " * 2000), ("en", "a " * 3000), *[("fr", "one two three four five six")] * 50]


@pytest.mark.parametrize(("longest", "least"), [(5, 3), (2, 1), (5, 40)])
def test_phrases(spark, longest, least):
    rows = awkward(longest * least)
    assert phrase_rows(spark, rows, longest, least) == plain_phrases(rows, longest, least, 2000)


def test_phrases_in_parts(spark, monkeypatch):
    """Pivots split by their neighbours, fragments cut segment by segment, small chunks, a short report."""
    from indexloom.llm import packed

    for where, name, value in ((phrases, "PIECE", 50), (phrases, "SEGMENT", 37), (packed, "CHUNK", 500), (packed, "ROW", 0)):
        monkeypatch.setattr(where, name, value)
    rows = awkward(5)
    assert phrase_rows(spark, rows, 5, 4, top=7) == plain_phrases(rows, 5, 4, 7)


def test_phrases_of_nothing(spark):
    assert phrase_rows(spark, [], 5, 2) == phrase_rows(spark, [("en", None), (None, "")], 5, 2) == phrase_rows(spark, [("en", "rare words only")], 5, 2) == []


def test_scores_beyond_64_bits(spark):
    """Products of counts of 10^16 stay exact."""
    a, n, left, right = 9_876_543_210_987_654, 9_999_999_999_999_999, 9_900_000_000_000_001, 9_999_999_999_999_998
    df = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    from pyspark.sql import functions as F

    got = df.withColumn("x", F.lit(1000).cast("decimal(4,0)") * (phrases._whole("a") * phrases._whole("n"))).withColumn("y", phrases._whole("l") * phrases._whole("r")).select(F.expr("x div y")).first()[0]
    assert got == 1000 * a * n // (left * right)


@given(st.lists(st.lists(st.integers(0, 3), min_size=3, max_size=3), min_size=1, max_size=30))
def test_equal_rows_meet(rows):
    table = np.array(rows, np.int32)
    order, new = phrases._same(table)
    seen = [tuple(table[i]) for i in order[new]]
    assert len(set(seen)) == len(seen) == len(set(map(tuple, rows)))
