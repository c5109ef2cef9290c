"""Toxicity: a learned lexicon, matched with misspellings, weighed by context.

From labelled rows outside the held-out fold a lexicon is learned: words, and beginnings of
words, that toxic documents have and others have not, at odds that chance does not give.  Its
trie is intersected with the Levenshtein automaton of the words read; the product is
determinised as it is walked, so most words die within a few characters.  Each hit is scored
by its place: inside a quotation, or close after words of attribution, it counts less, beside
other hits more.  A logistic model over the sums of these gives the score; its weights come from
documents that neither chose the terms nor the harmless variants that it then sees.

Scoring is one pass without a shuffle; a worker's tables are bounded.  Labels, lang, source
and doc_id are no inputs of a score.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexloom.llm.scratch import Scratch, columns
from indexloom.llm.workers import python_map

#: Labelled rows that a model is fitted on at most, by digest of their ids.
SAMPLE = 20_000
#: Words on either side of a hit that its context holds.
WINDOW = 8
#: Score from which a document is predicted toxic.
THRESHOLD = 0.3
#: Tokens, and moves of the automaton, that a worker keeps; beyond them its tables start anew.
KEEP, MOVES = 150_000, 200_000
#: Log odds from which a term marks toxic documents, and the probability of as many of them by chance.
ODDS, CHANCE = 3.0, 3e-6
#: Quotation marks, and words that introduce what others said.
QUOTES = "\"“”„«»‹›"
REPORTED = frozenset("said says wrote writes quoted quote quoting called calls termed according slur word sagte schrieb zitiert laut dit écrit selon dijo escribió según".split())
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + QUOTES + "’‘…–—¿¡"


@dataclass
class Term:
    text: str
    prefix: bool  # matches words that begin with it
    edits: int


@dataclass
class Lexicon:
    """A trie of terms and the automaton over it that allows each term its edits."""

    terms: list[Term]
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[list[int]] = field(default_factory=lambda: [[]])
    moves: dict[tuple[int, str], int] = field(default_factory=dict)
    states: list[frozenset] = field(default_factory=list)
    number: dict[frozenset, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for i, t in enumerate(self.terms):
            node = 0
            for c in t.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                node = self.children[node][c]
            self.ends[node].append(i)
        self.most = max((t.edits for t in self.terms), default=0)
        self.alphabet = frozenset("".join(t.text for t in self.terms))
        self._begin()

    def _begin(self) -> None:
        """The automaton with nothing but its first state."""
        self.moves, self.states, self.number = {}, [], {}
        self._state(frozenset())
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, pairs: set) -> frozenset:
        """With characters of terms left out, each for an edit."""
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if e < self.most:
                for child in self.children[node].values():
                    if (child, e + 1) not in pairs:
                        pairs.add((child, e + 1))
                        todo.append((child, e + 1))
        best: dict[int, int] = {}
        for node, e in pairs:
            best[node] = min(e, best.get(node, e))
        return frozenset(best.items())

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.number:
            self.number[pairs] = len(self.states)
            self.states.append(pairs)
        return self.number[pairs]

    def _move(self, state: int, c: str) -> int:
        nxt = set()
        for node, e in self.states[state]:
            if c in self.children[node]:
                nxt.add((self.children[node][c], e))
            if e < self.most:
                nxt.add((node, e + 1))
                nxt.update((child, e + 1) for child in self.children[node].values())
        out = self.moves[state, c] = self._state(self._closed(nxt))
        return out

    def match(self, word: str) -> tuple[int, int]:
        """(term, edits) of the closest term, or (-1, 0)."""
        if len(self.moves) > MOVES:
            self._begin()
        state, best, moves, alphabet = self.start, (9, -1), self.moves, self.alphabet
        for c in word:
            if c not in alphabet:
                c = ""  # all characters that no term has are one
            state = moves[state, c] if (state, c) in moves else self._move(state, c)
            if not state:
                break
            for node, e in self.states[state]:
                for i in self.ends[node]:
                    if self.terms[i].prefix and e <= self.terms[i].edits:
                        best = min(best, (e, i))
        if state:
            for node, e in self.states[state]:
                for i in self.ends[node]:
                    if e <= self.terms[i].edits:
                        best = min(best, (e, i))
        return (best[1], best[0]) if best[1] >= 0 else (-1, 0)


def bare(token: str) -> str:
    """A token without marks at its ends."""
    return token.strip(_EDGE)


class Reader:
    """Finds the hits of a text and sums them up by context."""

    def __init__(self, terms: list[Term], known: frozenset[str] = frozenset()):
        self.lexicon, self.known = Lexicon(terms), known
        self.kinds: dict[str, int] = {}  # token -> 0: none, 1: as in the lexicon, 2: misspelled

    def _learn(self, tokens: set[str]) -> None:
        for token in tokens:
            word = bare(token)
            term, edits = self.lexicon.match(word) if word else (-1, 0)
            self.kinds[token] = 0 if term < 0 else 1 if not edits else 0 if word in self.known else 2

    def hits(self, tokens: list[str]) -> list[int]:
        try:
            return list(map(self.kinds.__getitem__, tokens))
        except KeyError:
            if len(self.kinds) > KEEP:
                self.kinds.clear()
            self._learn({t for t in tokens if t not in self.kinds})
            return list(map(self.kinds.__getitem__, tokens))

    def features(self, text: str | None) -> list[float]:
        """Sums over hits: abuse, quoted, misspelled, the strongest context, hits by length, any."""
        tokens = (text or "").lower().split()
        kinds = self.hits(tokens)
        abuse = quoted = fuzzy = top = 0.0
        at = [i for i, k in enumerate(kinds) if k] if any(kinds) else []
        inside = quotations(tokens) if at else []
        for n, i in enumerate(at):
            said = any(bare(t) in REPORTED for t in tokens[max(0, i - WINDOW) : i])
            near = bisect.bisect_right(at, i + WINDOW, n) - bisect.bisect_left(at, i - WINDOW, 0, n + 1) - 1  # the other hits of the window, all of them
            cited = any(lo <= i <= hi for lo, hi in inside[max(0, bisect.bisect_right(inside, (i, len(tokens))) - 1) :][:1])
            weight = max(0.1, 1.0 - 0.6 * cited - 0.3 * said + 0.1 * near)
            if cited or said:
                quoted += weight
            if kinds[i] == 1:
                abuse += weight
            else:
                fuzzy += weight
            top = max(top, weight)
        return [math.log1p(abuse), math.log1p(quoted), math.log1p(fuzzy), top, math.log1p(100 * len(at) / max(20, len(tokens))), float(bool(at))]


def quotations(tokens: list[str]) -> list[tuple[int, int]]:
    """First and last token of each quotation, however long, in one pass over the text.

    A mark in front of a word opens one, the next mark behind a word closes it; marks that nothing closes, and marks
    behind words where none is open (such as inches), count as none.
    """
    out, opened = [], -1
    for i, t in enumerate(tokens):
        if not any(q in t for q in QUOTES):
            continue
        core = bare(t)
        before, _, after = t.partition(core) if core else (t, "", t)
        if opened < 0 and any(q in before for q in QUOTES):
            opened = i
            if not core:
                continue
        if opened >= 0 and any(q in after for q in QUOTES):
            out.append((opened, i))
            opened = -1
    return out


FEATURES = 6


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    terms: list[Term]
    known: frozenset[str]
    weights: list[float]  # of the features, then the constant

    def score(self, features: np.ndarray) -> np.ndarray:
        z = features @ np.array(self.weights[:-1]) + self.weights[-1]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _beginnings(text: str) -> set[str]:
    """The words of a text, closed by a blank, and their first 3 to 8 characters."""
    words = {w for t in set(text.lower().split()) if len(w := bare(t)) >= 3 and not w.isdigit()}
    return {w + " " for w in words} | {w[:k] for w in words for k in range(3, 9) if len(w) > k}


def _significant(rows: DataFrame, n_toxic: int, n_clean: int) -> list[tuple[str, int, int]]:
    """(term, toxic documents, clean documents) of the words and beginnings that mark toxic documents.

    ``rows``: text, y.  Counted in workers first, then over all; what does not stand out is gone before the driver sees it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                (toxic if y else clean).update(_beginnings(text or ""))
        terms = list(toxic | clean)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())], ["term", "t", "c"])

    sums = rows.select("text", "y").transform(python_map, count, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    strong = sums.where((F.col("t") >= least_documents(n_toxic, n_clean)) & (_log_odds(F.col("t"), F.col("c"), n_toxic, n_clean) >= ODDS - 1e-9))
    return [tuple(r) for r in strong.collect()]  # words of at most ``sample`` documents


def _log_odds(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    return F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((clean + 0.5) / (n_clean + 1))


def least_documents(n_toxic: int, n_clean: int) -> int:
    """So many toxic documents that chance would put all of them there less often than ``CHANCE``; one in 200 at least."""
    base = max(n_toxic / max(1, n_toxic + n_clean), 0.01)
    return max(4, n_toxic // 200, math.ceil(math.log(CHANCE) / math.log(min(0.5, base))))


def choose_terms(found: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> list[Term]:
    """Of the (term, toxic, clean) that stand out, the strongest of this round.

    A term's strength is its toxic documents times its log odds; the strongest is taken, the longest of equals, then
    the strongest of those that neither begin with it nor it with them, and so on down to a quarter of the first one's
    strength.  Weaker ones can be side effects of documents that these explain, so they are counted anew in the next round.
    """
    strength = {t: round(n * (math.log((n + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))), 6) for t, n, c in found}
    chosen: list[str] = []
    for t in sorted(strength, key=lambda t: (-strength[t], -len(t), t)):
        if strength[t] < strength[chosen[0]] / 4 if chosen else False:
            break
        if not any(t.startswith(c.rstrip(" ")) or c.startswith(t.rstrip(" ")) for c in chosen):
            chosen.append(t)
    return [Term(t.rstrip(" "), not t.endswith(" "), int(len(t.rstrip(" ")) >= (5 if t.endswith(" ") else 7))) for t in chosen]


def learn_terms(fold: DataFrame, terms: list[Term]) -> list[Term]:
    """``terms`` and those that the rows (text, y) add, round by round, until nothing stands out.

    Rarer terms stand out among the toxic documents that the terms so far do not explain; each round explains some, so it ends.
    """
    n_clean = fold.where("y = 0").count()
    left = _unexplained(fold.where("y = 1"), terms) if terms else fold.where("y = 1").select("text")
    rest = left.count()
    while rest >= 4 and n_clean:
        rows = left.withColumn("y", F.lit(1)).unionByName(fold.where("y = 0").select("text", "y"))
        new = choose_terms(_significant(rows, rest, n_clean), rest, n_clean)
        if not new:
            break
        terms = terms + new
        left, before = _unexplained(fold.where("y = 1"), terms), rest
        rest = left.count()
        if rest == before:
            break
    return terms


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> list[float]:
    """Weights and constant by Newton steps, with a ridge on the weights."""
    a = np.column_stack((x, np.ones(len(x))))
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (y - p) - penalty * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w += step * min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fits a model on at most ``sample`` labelled rows outside the held-out fold.

    Without labels of both kinds the lexicon is empty and every score is the share of toxic labels.
    """
    scratch = Scratch(docs.sparkSession)
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~is_held_out(F.col(id_col))).select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("int").alias("_y"))
    picked = F.broadcast(rows.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample))  # bounded by ``sample`` rows
    fold = scratch.cut(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(picked, "_id").select("text", F.col("_y").alias("y"), F.pmod(F.xxhash64("_id"), F.lit(2)).cast("int").alias("half")), "sample")
    n = {r["y"]: r["n"] for r in fold.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        share = (n_toxic + 0.5) / (n_toxic + n_clean + 1) if n_toxic + n_clean else 0.01
        return Model([], frozenset(), [0.0] * FEATURES + [math.log(share / (1 - share))])
    # the weights come from one half, with terms and variants of the other; then the first half adds its own
    one, other = fold.where("half = 0"), fold.where("half = 1")
    terms = learn_terms(one, [])
    known = _known_variants(one, terms)
    weights = _weights(other, terms, known)
    terms = learn_terms(fold, terms)
    known = _known_variants(fold, terms)
    scratch.drop(fold)
    return Model(terms, known, weights)


def _weights(fold: DataFrame, terms: list[Term], known: frozenset[str]) -> list[float]:
    """The logistic model over the features of the rows (text, y)."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(terms, known)
        for b in batches:
            f = np.array([reader.features(t) for t in b.column(0).to_pylist()], float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(1), *[pa.array(f[:, j]) for j in range(FEATURES)]], ["y", *[f"f{j}" for j in range(FEATURES)]])

    got = fold.select("text", "y").transform(python_map, extract, "y int, " + ", ".join(f"f{j} double" for j in range(FEATURES))).collect()  # ``sample`` rows at most
    data = np.array(sorted(got), float).reshape(-1, FEATURES + 1)
    return fit_logistic(data[:, 1:], data[:, 0])


def _unexplained(sample: DataFrame, terms: list[Term]) -> DataFrame:
    """The rows of a sample without a hit."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader([Term(t.text, t.prefix, 0) for t in terms])
        for b in batches:
            yield b.filter(pa.array([not any(reader.hits((t or "").lower().split())) for t in b.column(0).to_pylist()], pa.bool_()))

    return sample.select("text").transform(python_map, keep, "text string")


def _known_variants(fold: DataFrame, terms: list[Term]) -> frozenset[str]:
    """Words near a term that documents without toxicity use at least as often: no misspellings."""
    if not terms:
        return frozenset()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, clean, toxic = Lexicon(terms), Counter(), Counter()
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w in {bare(t) for t in set((text or "").lower().split())}:
                    if lexicon.match(w)[1]:
                        (toxic if y else clean)[w] += 1
        words = list(clean | toxic)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([clean[w] for w in words], pa.int64()), pa.array([toxic[w] for w in words], pa.int64())], ["w", "c", "t"])

    sums = fold.select("text", "y").transform(python_map, near, "w string, c long, t long").groupBy("w").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    return frozenset(r["w"] for r in sums.where("c > 0 and c >= t").collect())  # words of at most ``sample`` documents


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with held_out, score and predicted; null text counts as empty, every row is on its own.

    Columns of ``docs`` with the names of the result are replaced.  Repeated rows get equal scores; a null id is not
    held out; a text of any length is read whole, in one pass; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.terms, model.known, model.weights))  # bounded by the words of ``sample`` documents
    plain = [c for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, known, weights = shared.value
        reader, m = _reader(terms, known, weights)
        for b in batches:
            f = np.array([reader.features(t) for t in b.column(len(plain)).to_pylist()], float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(plain)], pa.array(m.score(f))], [*plain, "score"])

    source = docs.select(*plain, F.col(text_col).alias("_read"))
    out = source.transform(python_map, read, docs.select(*plain).schema.add("score", "double"))
    return out.withColumn("held_out", is_held_out(F.col(id_col))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


_READERS: dict[tuple, tuple[Reader, Model]] = {}


def _reader(terms: list[Term], known: frozenset[str], weights: list[float]) -> tuple[Reader, Model]:
    """The worker's reader of a model, kept between tasks."""
    key = (tuple(weights), tuple((t.text, t.prefix, t.edits) for t in terms), known)
    if key not in _READERS:
        _READERS.clear()
        _READERS[key] = Reader(terms, known), Model(terms, known, weights)
    return _READERS[key]


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row, empty and null texts too; other columns are left out.

    Labels without id or value, or of ids that ``docs`` does not have, do not count; without labels of both kinds every
    score is one constant.
    """
    model = train(docs, labels, id_col, text_col)
    return score(docs.select(F.col(id_col), F.col(text_col)), model, id_col, text_col).select(id_col, "held_out", "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with their own columns, whatever these are named; null and empty texts
    have no hits."""
    model = train(docs, labels, id_col, text_col)
    rows = docs.select(F.struct(columns(docs)).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return score(rows, model, "_id", "_text").where("predicted = 0").select("_row.*")
