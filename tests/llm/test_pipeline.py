"""The pipeline: each stage against brute force over its own input."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import cases
from tests.llm.test_stores import check_packing, crc, ids_of

BAD = ["grobnik", "fultish", "zarpo"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rnd = random.Random(11)
    plain = [f"{a}{b}{c}" for a in ("ta", "ri", "mo", "ke") for b in ("lan", "ser", "dil") for c in ("", "e", "us", "ath")]
    docs, labels, texts = [], [], []
    for i in range(900):
        pick = rnd.random()
        if texts and pick < 0.1:
            t = rnd.choice(texts).replace(" ", rnd.choice([" ", "\n", "  "]))
        elif texts and pick < 0.2:
            w = rnd.choice(texts).split()
            w[rnd.randrange(len(w))] = "changed"
            t = " ".join(w)
        else:
            t = " ".join(rnd.choices(plain, k=rnd.randint(3, 90)))
        toxic = rnd.random() < 0.12
        if toxic:
            t = f"{rnd.choice(BAD)} {t} {rnd.choice(BAD)}"
        else:
            texts.append(t)
        docs.append((i, t, "en", rnd.choice(["s1", "s1", "s2", None]), len(t)))
        if i % 2:
            labels.append((i, 1, int(toxic)))
    docs += [(900, None, None, None, None), (901, "", "en", "s1", 0), (902, " \n ", "en", "s2", 3), (None, "without a number", "en", "s1", 16)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, results = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, results[-1], sf_dir)
        out.write.parquet(f"file://{tmp_path}/{k}")
        results.append(spark.read.parquet(f"file://{tmp_path}/{k}"))
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
    rows = [[tuple(r) for r in x.collect()] for x in results[:-1]]
    whole, clean, single, apart, mixed = rows

    def toxic(r):
        return any(b in (r[1] or "") for b in BAD)

    gone = Counter(whole) - Counter(clean)
    assert all(toxic(r) for r in gone.elements()) and not [r for r in clean if toxic(r)]

    groups = {}
    for r in clean:
        key = cases.GAP.sub(" ", r[1] or "")
        old = groups.get(key)
        if old is None or (r[0] is not None and (old[0] is None or r[0] < old[0])):
            groups[key] = r
    assert Counter(groups.values()) == Counter(single)

    comps = cases.jaccard([(r[0], r[1]) for r in single])
    want = {i for i, n, c in comps if n == 0 or i == c}
    assert {r[0] for r in apart} == want and len(apart) == len(want)

    words, size, by_id = Counter(), Counter(), {r[0]: r for r in apart}
    for r in mixed:
        n = len(cases.words(r[1]))
        words[r[0]] += n
        size[r[3]] += n
        assert r[2:] == by_id[r[0]][2:] and cases.words(by_id[r[0]][1])[:n] == cases.words(r[1])
    total = sum(len(cases.words(r[1])) for r in apart)
    assert abs(sum(size.values()) - 1.5 * total) <= 3
    assert all(n <= 2 * len(cases.words(by_id[i][1])) for i, n in words.items())

    tok = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    packed = results[-1].collect()
    used = check_packing([(r.sequence_id, r.offset, r.length) for r in packed], 4096)
    expected = Counter()
    for r in mixed:
        ids = ids_of(tok, r[1]) + [1]
        expected.update((r[0], k, at, len(ids[at : at + 4096]), crc(ids[at : at + 4096])) for k, at in enumerate(range(0, len(ids), 4096)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == expected
    assert used <= np.ceil(sum(r.length for r in packed) / 4096) + 1


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() > 300 and "sequence_id" in got.columns
