"""Mixing, packing, token files and media against brute force and round trips."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from indexloom.llm import media, mixing, packing, token_orc
from indexloom.llm.tokens import Encoder, slices
from tests.llm import cases

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark)


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(VOCABULARY)


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# tokens


PIECES = [*"abZ'st.,!? \t\n\x0b\x1c\x1f\x85\xa0\u2003\u3000\u200bßÉİΣςſµª²½é\u0301中😀ǅﬁK#$%&*()[]{}_^`~", "<|endoftext|>", "<|EndOfText|>", "'ll", "don't", "%" * 9]
TEXTS = st.lists(st.none() | st.lists(st.sampled_from(PIECES), max_size=20).map("".join), max_size=5)


@given(TEXTS, st.none() | st.just(7))
@settings(max_examples=400, deadline=None)
def test_words_encode_as_texts(texts, end):
    enc = test_words_encode_as_texts.__dict__.setdefault("enc", Encoder(VOCABULARY))
    assert enc.by_word
    ids, at = enc.encode_many(pa.array(texts, pa.string()), end)
    assert len(at) == len(texts) + 1 and at[-1] == len(ids)
    tail = b"" if end is None else np.array([end], "<u4").tobytes()
    for t, lo, hi in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[lo:hi].tobytes() == (enc.whole(t) if t else b"") + tail
        assert enc.encode(t) + tail == ids[lo:hi].tobytes()


@given(st.lists(st.none() | st.integers(0, 9).map("x".__mul__), max_size=12))
def test_slices_cover_all_rows(texts):
    got = list(slices(pa.array(texts, pa.string()), 10))
    assert [lo for lo, _ in got] == [sum(n for _, n in got[:k]) for k in range(len(got))] and sum(n for _, n in got) == len(texts)
    assert all(n == 1 or sum(len(t or "") for t in texts[lo : lo + n]) <= 10 for lo, n in got)


def test_other_vocabularies_encode_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, tok = Encoder(path), Tokenizer.from_file(path)
    assert not enc.by_word
    assert np.frombuffer(enc.encode("Some  text, here\n"), "<u4").tolist() == tok.encode("Some  text, here\n", add_special_tokens=False).ids


def test_table_of_words_is_bounded(monkeypatch):
    from indexloom.llm import tokens

    monkeypatch.setattr(tokens, "KEEP", 50)
    enc = Encoder(VOCABULARY)
    for i in range(300):
        text = f"word{i} again Word{i - 1}, über{i}."
        assert enc.encode(text) == enc.whole(text)
    assert len(enc.pieces) + len(enc.older) < 150


# ORC


def test_orc(spark, docs, tok, tmp_path):
    path = f"file://{tmp_path}/ids"
    token_orc.write(docs, path, VOCABULARY, end_id=2, parts=3)
    stored = token_orc.read(spark, path)
    data = [(r.doc_id, r.text) for r in docs.collect()]
    whole = {(i, tuple(ids_of(tok, t) + [2])) for i, t in data}
    assert {(r.doc_id, tuple(r.ids)) for r in stored.collect()} == whole
    got = token_orc.digest(stored).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(ids_of(tok, t)) + 1, crc(ids_of(tok, t) + [2])) for i, t in data)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert order == sorted(order)
    assert sorted(r.doc_id for r in token_orc.read(spark, path, [3, 14]).collect()) == [3, 14]


def test_orc_stripes_and_pruning(spark, tmp_path):
    import pyarrow.orc as orc

    path = f"file://{tmp_path}/many"
    token_orc.write(spark.range(3000).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 300) AS text"), path, VOCABULARY, parts=2)
    files = sorted((tmp_path / "many").glob("*.orc"))
    assert len(files) == 2
    seen = []
    for f in files:
        o = orc.ORCFile(f)
        seen += [x for k in range(o.nstripes) for x in o.read_stripe(k, columns=["doc_id"]).column("doc_id").to_pylist()]
        assert f.stat().st_size < 4 * sum(o.read(columns=["n_tokens"]).column("n_tokens").to_pylist())
    assert seen == list(range(3000))
    plan = token_orc.read(spark, path, [17])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(doc_id,17)" in plan.replace(" ", "")


# packing


def check_packing(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r[0]].append((r[1], r[2]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), max_size=30))
@settings(max_examples=300, deadline=None)
def test_histogram(counts):
    plan = packing.pack_histogram(counts, 60)
    rows, placed = [], Counter()
    for n, first, m, low, each, offset in plan:
        assert first == placed[n]
        placed[n] += m
        rows += [(low + k // each, offset + n * (k % each), n) for k in range(m)]
    assert placed == Counter(counts)
    used = check_packing(rows, 60)
    total = sum(n * c for n, c in counts.items())
    # best fit by decreasing size needs at most 11/9 of the least number of bins, and one more
    large = sum(c for n, c in counts.items() if 2 * n > 60)
    assert used <= max(-(-total // 60), large) * 11 / 9 + 1 or used <= best_fit_decreasing(counts, 60) + 1


def best_fit_decreasing(counts, capacity):
    gaps = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fits = [g for g in gaps if g >= n]
            if fits:
                g = min(fits)
                gaps.remove(g)
                gaps.append(g - n)
            else:
                gaps.append(capacity - n)
    return len(gaps)


def test_large_items_are_matched():
    assert len({low + k for n, _, m, low, _, _ in packing.pack_histogram({34: 1, 66: 1, 50: 2, 40: 1, 60: 1}, 100) for k in range(m)}) == 3


def test_lengths_must_fit():
    with pytest.raises(ValueError):
        packing.pack_histogram({101: 1}, 100)


@pytest.mark.parametrize("capacity", [4096, 16, 1])
def test_packed_documents(docs, tok, capacity):
    got = packing.best_fit(docs, VOCABULARY, 1, capacity).collect()
    check_packing([(r.sequence_id, r.offset, r.length) for r in got], capacity)
    expected = []
    for r in docs.collect():
        ids = ids_of(tok, r.text) + [1]
        expected += [(r.doc_id, k, at, len(ids[at : at + capacity]), crc(ids[at : at + capacity])) for k, at in enumerate(range(0, len(ids), capacity))]
    assert cases.key((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == cases.key(expected)


# mixing


@pytest.mark.parametrize("block", [mixing.BLOCK, 5])
def test_mix(docs, block):
    got = mixing.mix(docs, block=block)
    rows = got["documents"].collect()
    data = docs.collect()
    sizes = Counter()
    for r in data:
        sizes[r.source] += len(cases.words(r.text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(target.values())
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    by_size = Counter((r.doc_id, r.size) for r in rows)
    assert by_size == Counter((r.doc_id, len(cases.words(r.text))) for r in data)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    taken, wanted = Counter(), {}
    for r in rows:
        taken[r.source_size, round(r.target, 6)] += r.taken
        wanted[r.source_size, round(r.target, 6)] = r.target
    count = Counter((sizes[s], round(target[s], 6)) for s in order)
    for k, n in count.items():
        assert abs(taken[k] - n * wanted[k]) <= n
    assert Counter(map(tuple, rows)) != Counter() and Counter((r.doc_id, r.taken) for r in mixing.mix(docs, block=block)["documents"].collect()) == Counter((r.doc_id, r.taken) for r in rows)
    # the order of the mix keeps to the weights all along
    plan = got["schedule"].orderBy("slot").collect()
    assert sum(r.words for r in plan) == sum(r.taken for r in rows)


@given(st.integers(0, (1 << 44) - 1))
def test_points(i):
    """The expression of a point, in Python's integers."""
    half, one = mixing.BITS // 2, (1 << mixing.BITS // 2) - 1
    high, low = mixing.PHI >> half, mixing.PHI & one
    across = (i & one) * high + (i >> half) * low
    whole = ((across & one) << half) + (i & one) * low
    assert across < 1 << 63 and whole < 1 << 63
    assert whole & ((1 << mixing.BITS) - 1) == i * mixing.PHI % (1 << mixing.BITS)


def test_small_sources_beside_huge_ones(spark):
    """Every source gets its slots, however small its part; the schedule is not laid out for it."""
    ids = [0, 1, 12345, (1 << 33) + 7, (1 << 43) - 1]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "id long").select(mixing._point("id")).collect()]
    assert got == [i * mixing.PHI % (1 << mixing.BITS) for i in ids]
    data = [(i, "w " * 5000, "big") for i in range(60)] + [(100, "a b c", "small"), (101, "x", "tiny")]
    plan = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string"), block=3, weights=(1, 1, 1))
    taken = Counter()
    for r in plan["documents"].collect():
        taken[r.source_size] += r.taken
    assert taken[3] == 6 and taken[1] == 2


def test_schedule_is_even(spark):
    data = [(i, "w " * 50, "ab"[i % 2]) for i in range(400)]
    plan = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string"), block=50)["schedule"].orderBy("slot").collect()
    a = 0
    for k, r in enumerate(plan[:300], 1):
        a += r._source == "a"
        assert abs(a - k * 2 / 3) < 6  # targets 20,000 and 10,000


def test_mixed_rows(docs):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    taken = Counter()
    for r in mixing.mix(docs)["documents"].collect():
        taken[r.doc_id] += r.taken
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(cases.words(r.text))
    assert words == Counter({k: v for k, v in taken.items() if v})


# media


def test_known_stream():
    """The ten by ten picture of four colours that GIF tutorials take apart."""
    data = bytes.fromhex("8c2d99872a1cdc33a00275ec95faa8de608c04914c01")
    got = media.lzw_decode(data, 2)
    rows = [[1] * 5 + [2] * 5] * 3 + [[1] * 3 + [0] * 4 + [2] * 3] * 2 + [[2] * 3 + [0] * 4 + [1] * 3] * 2 + [[2] * 5 + [1] * 5] * 3
    assert list(got) == [x for r in rows for x in r]


@given(st.binary(max_size=3000), st.integers(1, 256))
@settings(max_examples=100, deadline=None)
def test_lzw_round_trip(data, colours):
    data = bytes(b % colours for b in data)
    assert media.lzw_decode(media.lzw_encode(data)) == data


@pytest.mark.parametrize("size", [64, 6400, 64 * media.ROWS, 64 * media.ROWS + 64, 64 * (2 * media.ROWS + 5)])
def test_frames_round_trip(size):
    rnd = random.Random(size)
    for data in (rnd.randbytes(size), bytes(size), bytes(rnd.choices(b"ab", k=size))):
        gif = media.gif_encode(data)
        assert media.gif_payload(gif) == data
        assert len(media.frames(gif)[2]) == -(-size // (64 * media.ROWS))


def test_disposal_and_transparency():
    def frame(x, y, w, h, samples, disposal, clear=None):
        control = b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), 5, 0, clear or 0, 0])
        return control + b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (x, y, w, h)) + b"\0\x08" + media._blocks(media.lzw_encode(bytes(samples)))

    head = b"GIF89a" + (2).to_bytes(2, "little") * 2 + bytes([0xF7, 0, 0]) + media._GREY
    gif = head + frame(0, 0, 2, 2, [10, 20, 30, 40], 1) + frame(0, 0, 2, 1, [50, 60], 3, clear=60) + frame(1, 1, 1, 1, [70], 2) + frame(0, 0, 1, 1, [80], 0) + b";"
    shown = [p[:, :, 0].tolist() for p, _ in media.composed(gif)]
    seen = [p[:, :, 3].tolist() for p, _ in media.composed(gif)]
    assert shown == [[[10, 20], [30, 40]], [[50, 20], [30, 40]], [[10, 20], [30, 70]], [[80, 20], [30, 0]]]
    assert seen[3] == [[255, 255], [255, 0]]
    assert [f.delay for _, f in media.composed(gif)] == [5] * 4
    assert media.gif_payload(gif) == bytes([10, 20, 30, 40, 50, 20, 70, 80])


def test_streams_go_on_with_a_full_table():
    """Codes of 12 bits for long after the table is full, and no clear code; a stream that stops short is an error."""
    rnd = random.Random(1)
    data = rnd.randbytes(300_000)
    codes, known, last = [256], {bytes((i,)): i for i in range(256)}, b""
    for b in data:
        if last + bytes((b,)) in known:
            last += bytes((b,))
            continue
        codes.append(known[last])
        if len(known) < 4096 - 2:
            known[last + bytes((b,))] = len(known) + 2
        last = bytes((b,))
    codes += [known[last], 257]
    bits, n, out, size = 0, 0, bytearray(), 258
    for k, c in enumerate(codes):
        width = 9 if not k else min(12, max(9, (min(size, 4095)).bit_length()))
        bits |= c << n
        n += width
        if k > 1 and size < 4096:
            size += 1
        while n >= 8:
            out.append(bits & 255)
            bits, n = bits >> 8, n - 8
    out.append(bits & 255)
    assert media.lzw_decode(bytes(out)) == data
    gif = media.gif_encode(bytes(range(64)) * 4)
    with pytest.raises(ValueError):
        media.frames(gif[:-6])
    at = gif.index(b"\x2c" + bytes(4) + b"\x40\0") + 7
    with pytest.raises(ValueError):
        media.frames(gif[:at] + bytes([9]) + gif[at + 1 :])


def test_media_columns(docs):
    got = media.features(media.with_media(docs)).collect()
    expected = []
    for r in docs.collect():
        raw = (r.text or "").encode()
        p = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        expected.append((r.doc_id, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert cases.key((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == cases.key(expected)
    assert all(sum(sum(f[c]) for f in r.frames) == r.payload_bytes for r in got for c in ("red", "green", "blue"))
    assert all(len(r.frames) == r.n_frames and sum(f.delay_cs for f in r.frames) == r.duration_cs for r in got)
    by_text = defaultdict(set)
    for r in got:
        by_text[r.payload_sha256, r.n_bytes].add((r.media_sha256, r.media_bytes, r.feature))
    assert all(len(v) == 1 for v in by_text.values())


def test_empty_tables(spark, tmp_path):
    none = cases.documents(spark, [])
    assert mixing.mix(none)["documents"].count() == 0
    assert mixing.mixed(none).count() == 0
    assert packing.best_fit(none, VOCABULARY).count() == 0
    assert media.features(media.with_media(none)).count() == 0
    token_orc.write(none, f"file://{tmp_path}/none", VOCABULARY)
    assert token_orc.digest(token_orc.read(spark, f"file://{tmp_path}/none")).count() == 0
