"""Small tables with every awkward case, and brute-force versions of what the queries return."""

import hashlib
import re
import zlib
from collections import defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GAP = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, taken int, _uid long, kept boolean, n int, score string, row_number int"

_A = " ".join(f"alpha{i % 37}x{i % 11}" for i in range(90))
_B = " ".join(f"beta{i * i % 101}" for i in range(70))
_RUN = " ".join(f"shared{i}" for i in range(30))


def rows() -> list[tuple]:
    """Nulls, empties, white space, ties, repeated rows, near copies, shared passages, a very long text."""
    texts = [
        (1, _A, "s1"), (2, _A.replace(" ", "\n\t "), "s1"), (3, _A + " one more", "s2"), (4, None, "s2"), (5, "", None), (6, " \t\n\x0b\x0c\r ", "s3"),
        (7, _B + " " + _RUN, "s1"), (8, _RUN + " " + _B.upper(), "s1"), (9, "x", "s1"), (9, "x", "s1"), (10, "two words", "s4"), (11, "two words nbsp", None),
        (12, _RUN + " " + _RUN, "s1"), (13, "ÄÖ ß é 中文 😀 <|endoftext|> don't 'll", "s5"), (14, " ".join(f"w{i % 977}q{i % 131}" for i in range(9000)), "s1"),
        (15, _A.replace("alpha5x5", "changed", 1), "s1"), (None, "no id", "s1"), (None, None, None), (16, "x", "s9"), (17, "a b c d e", "s1"), (18, "A b  c d E", "s2"), (-3, "negative id\nsecond line\n", "s2"),
        (19, "line\ncommon line here\nother", "s6"), (20, "common line here", "s7"),
    ]
    return [(i, t, "en", s, None if t is None else len(t), 7, 8, 1, True, 9, "z", 3) for i, t, s in texts]


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def exact(docs):
    """(doc_id, keep_id, group_size, sha) of each row; null ids come after all others."""
    groups = defaultdict(list)
    for i, t in docs:
        groups[GAP.sub(" ", t or "")].append(i)
    out = []
    for i, t in docs:
        k = GAP.sub(" ", t or "")
        ids = [x for x in groups[k] if x is not None]
        out.append((i, min(ids) if ids else None, len(groups[k]), sha(k)))
    return out


def shingle_set(text):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(docs):
    """(doc_id, n_shingles, component_id) of each row."""
    sets = [shingle_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(docs)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            root[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(docs)]


def substrings(docs, span=20):
    """(doc_id, n_words, n_removed, sha) of rows in order of doc_id."""
    seen, out = set(), []
    for i, t in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)):
        w = words(t)
        drop = [False] * len(w)
        for s in range(len(w) - span + 1):
            key = tuple(w[s : s + span])
            if key in seen:
                drop[s : s + span] = [True] * span
            seen.add(key)
        out.append((i, len(w), sum(drop), sha(" ".join(x for x, d in zip(w, drop, strict=True) if not d))))
    return out


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def key(rows):
    """Rows as a sorted list, with None before numbers."""
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))
