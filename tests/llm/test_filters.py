"""Toxicity and URL filters."""

import math
import random
from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from indexloom.llm import toxicity, url_filter
from tests.llm import cases


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=6), st.booleans(), st.integers(0, 2)), min_size=1, max_size=6), st.text("abc", max_size=8))
@settings(max_examples=500, deadline=None)
def test_automaton(terms, word):
    lexicon = toxicity.Lexicon([toxicity.Term(*t) for t in terms])
    best = [min((distance(t, word[:j]) for j in (range(1, len(word) + 1) if prefix else [])), default=99) for t, prefix, _ in terms]
    best = [min(b, distance(t, word)) for b, (t, _, _) in zip(best, terms, strict=True)]
    hits = [b for b, (_, _, edits) in zip(best, terms, strict=True) if b <= edits]
    term, edits = lexicon.match(word)
    if word:
        assert (term >= 0) == bool(hits)
        if hits:
            assert edits == min(hits) == best[term]


def test_context():
    reader = toxicity.Reader([toxicity.Term("idiot", False, 1)])
    abuse, quoted, fuzzy, top, _, anything = reader.features("you are an idiot and a fool")
    assert abuse > 0 and not quoted and not fuzzy and anything == 1
    cited = reader.features('she said "you idiot" to them')
    assert cited[1] > 0 and cited[3] < top
    assert reader.features("you are an idi0t")[2] > 0
    assert reader.features("an idiot idiot idiot")[3] > top
    assert reader.features(None) == reader.features("") == [0.0] * toxicity.FEATURES


def test_every_hit_of_the_window_counts():
    """17 hits in a row: the middle one has 16 others near it."""
    reader = toxicity.Reader([toxicity.Term("idiot", False, 0)])
    assert reader.features("idiot " * 17)[3] == pytest.approx(1 + 0.1 * 16)
    assert reader.features("idiot " * 60)[3] == pytest.approx(1 + 0.1 * 16)
    assert reader.features("idiot " + "blue " * 8 + "idiot")[3] == pytest.approx(1.0)


def test_quotations():
    """From the mark that opens one to the mark that closes it, however far; marks that nothing closes are none."""
    far = '"' + "blue " * 40 + 'idiot", she said, "and'
    reader = toxicity.Reader([toxicity.Term("idiot", False, 0)])
    assert reader.features(far)[1] > 0
    assert toxicity.quotations(far.split()) == [(0, 40)]
    assert toxicity.quotations('a 5" idiot and "open'.split()) == []
    assert toxicity.quotations('« un idiot » et „noch einer“ "x"'.split()) == [(0, 3), (5, 6), (7, 7)]
    # abuse after a quotation that began outside the window
    after = reader.features('"' + "blue " * 12 + 'end" you idiot ' + "blue " * 12 + '"b c"')
    assert after[0] > 0 and not after[1]


def test_automaton_is_bounded(monkeypatch):
    monkeypatch.setattr(toxicity, "MOVES", 300)
    rnd = random.Random(3)
    lexicon = toxicity.Lexicon([toxicity.Term("abcabd", False, 1), toxicity.Term("bdd", True, 0)])
    for _ in range(3000):
        word = "".join(rnd.choices("abcdéü中", k=rnd.randint(1, 8)))
        want = distance("abcabd", word) <= 1 or word.startswith("bdd")
        assert (lexicon.match(word)[0] >= 0) == want
        assert len(lexicon.moves) < 320 and len(lexicon.states) < 320


def brute_features(model, text):
    """The features of a text from all terms, tokens and positions."""
    tokens = (text or "").lower().split()
    spans, opened = [], None
    for i, t in enumerate(tokens):
        if '"' in t:
            if opened is None and t.startswith('"'):
                opened = i
            if opened is not None and t.rstrip(".,").endswith('"') and t.strip('".,'):
                spans.append((opened, i))
                opened = None
    kinds = []
    for t in tokens:
        w = toxicity.bare(t)
        best = min((distance(x.text, w[:j]) for x in model.terms for j in ([len(w)] + (list(range(1, len(w))) if x.prefix else [])) if w and distance(x.text, w[:j]) <= x.edits), default=None)
        kinds.append(0 if best is None else 1 if best == 0 else 0 if w in model.known else 2)
    at = [i for i, k in enumerate(kinds) if k]
    sums = {"abuse": 0.0, "quoted": 0.0, "fuzzy": 0.0, "top": 0.0}
    for i in at:
        said = any(toxicity.bare(t) in toxicity.REPORTED for t in tokens[max(0, i - 8) : i])
        others = [j for j in at if j != i]
        cited = any(a <= i <= b for a, b in spans)
        weight = max(0.1, 1 - 0.6 * cited - 0.3 * said + 0.1 * sum(abs(j - i) <= 8 for j in others))
        sums["quoted"] += weight * (cited or said)
        sums["abuse" if kinds[i] == 1 else "fuzzy"] += weight
        sums["top"] = max(sums["top"], weight)
    return [math.log1p(sums["abuse"]), math.log1p(sums["quoted"]), math.log1p(sums["fuzzy"]), sums["top"], math.log1p(100 * len(at) / max(20, len(tokens))), float(bool(at))]


def test_scores_against_brute_force(spark):
    """Scores of a learned model from all terms, tokens and positions."""
    docs, labels = labelled(spark, 900)
    model = toxicity.train(docs, labels)
    rnd = random.Random(6)
    pieces = ["grobnik", "grobnikk", '"grobnik', 'fultish"', "zarpo,", '"zarpo"', "wrote", "talan", "riser", "modil", "keser.", "Grobnik!", "zarpos", "fultis", '5"']
    texts = [None, "", " "] + [" ".join(rnd.choices(pieces, k=rnd.randint(1, 40))) for _ in range(60)]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        z = sum(a * b for a, b in zip(model.weights, [*brute_features(model, t), 1.0], strict=True))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)


def labelled(spark, n=1500):
    rnd = random.Random(2)
    plain = [f"{a}{b}{c}" for a in ("ta", "ri", "mo", "ke") for b in ("lan", "ser", "dil") for c in ("", "e", "us", "ath")]
    bad = ["grobnik", "fultish", "zarpo"]
    docs, labels = [], []
    for i in range(n):
        w = rnd.choices(plain, k=rnd.randint(4, 60))
        toxic = rnd.random() < 0.15
        if toxic:
            for _ in range(rnd.randint(1, 4)):
                w.insert(rnd.randrange(len(w)), rnd.choice(bad) + rnd.choice(["", ",", "."]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learned_on_one_fold_serves_the_other(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    assert {t.text for t in model.terms} >= {"grobnik", "fultish", "zarpo"}
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == cases.held_out(i) for i, r in got.items())
    out = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].predicted == truth[i] for i in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    # held-out labels make no difference
    other = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS STRING)) % 4 = 2, 1 - toxic, toxic) AS toxic")
    again = {r.doc_id: r.score for r in toxicity.score_documents(docs, other).collect()}
    assert again == {i: r.score for i, r in got.items()}
    # misspelt terms and terms in quotation
    probe = spark.createDataFrame([(1, "talan grobnikk riser"), (2, "you grobnik fultish zarpo"), (3, 'they wrote "grobnik" once in a letter of talan')], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.score(probe, model).collect()}
    assert scores[2] > scores[3]


def test_keeps_clean_rows(spark):
    docs, labels = labelled(spark)
    wide = docs.selectExpr("doc_id", "text", "1 AS score", "'x' AS predicted", "2 AS _row", "3 AS _read")
    kept = toxicity.keep_clean(wide, labels)
    assert kept.columns == wide.columns
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    ids = {r.doc_id for r in kept.collect()}
    assert sum(truth[i] for i in ids) <= 3 and len(ids) >= 0.98 * sum(1 - y for y in truth.values())


def test_awkward_rows_and_labels(spark):
    docs = cases.documents(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (2, None), (3, 0), (99, 1)], "doc_id long, toxic int")
    for labels in (none, odd):
        got = toxicity.score_documents(docs, labels).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_documents(docs.limit(0), odd).count() == 0


# URL lists


@pytest.mark.parametrize(
    ("url", "host"),
    [("https://User:pw@WWW.Example.org:8080/a?b#c", "www.example.org"), ("http://a.b.", "a.b"), ("ftp://x/y", "x"), ("no url", ""), (None, ""), ("", ""), ("http://", ""), ("http://h?x@y/", "h")],
)
def test_hosts(spark, url, host):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(url,)], "u string").select(url_filter.host_of(F.col("u")).alias("h")).first().h == host


def test_list_over_time(spark):
    rnd = random.Random(9)
    day0 = date(2024, 1, 1)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "other.org", "hot.net", "x"]
    events = [(rnd.choice([*hosts, None]), rnd.choice(["spam", "adult"]), day0 + timedelta(days=rnd.randrange(200)), rnd.choice(["add", "remove", "add", "noise"])) for _ in range(60)]
    captures = [(k, f"http://{rnd.choice(hosts)}/p{k}", day0 + timedelta(days=rnd.randrange(220))) for k in range(150)] + [(200, None, day0), (201, "junk", day0), (202, "http://hot.net/", None), (203, "http://hot.net/", day0), (203, "http://hot.net/", day0)]
    got = url_filter.temporal_filter(spark.createDataFrame(captures, "page_id long, url string, day date"), spark.createDataFrame(events, "key string, category string, day date, action string")).collect()

    active = {}
    for key in hosts:
        for category in ("spam", "adult"):
            on, since, out = False, None, []
            for d, remove_last in sorted((e[2], e[3] != "remove") for e in events if e[0] == key and e[1] == category and e[3] in ("add", "remove")):
                if remove_last and not on:
                    on, since = True, d
                elif not remove_last and on:
                    on = False
                    out.append((since, d))
            active[key, category] = [*out, (since, date.max)] if on else out
    expected = []
    for k, url, d in captures:
        host = url[7:].split("/")[0] if url and url.startswith("http://") else ""
        best = min(((-len(key), since, category, key) for (key, category), spans in active.items() for since, until in spans if d and host and (host == key or host.endswith("." + key)) and since <= d < until), default=None)
        expected.append((k, best is not None, best and best[2], best and best[3], best and best[1]))
    assert cases.key((r.page_id, r.blocked, r.category, r.list_key, r.since) for r in got) == cases.key(expected)
    assert any(x[1] for x in expected)


def test_no_captures_or_entries(spark):
    pages = spark.createDataFrame([(1, "http://a.b/", date(2024, 1, 1))], "page_id long, url string, day date")
    entries = spark.createDataFrame([("a.b", "spam", date(2023, 1, 1), "add")], "key string, category string, day date, action string")
    assert url_filter.temporal_filter(pages.limit(0), entries).count() == 0
    assert not url_filter.temporal_filter(pages, entries.limit(0)).first().blocked
    assert url_filter.temporal_filter(pages, entries).first().blocked
