"""Text conventions that the operators share, as SQL patterns and as vectorised numpy kernels.

White space is the six ASCII characters 0x20 and 0x09-0x0D; a word is a run of others.
"""

from __future__ import annotations

import numpy as np

#: Java and RE2 patterns of a run of white space and of a word.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Odd multipliers of the rolling hash and of a second one, and the values that they give to bytes.
_P = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_TABLE = [np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (20240501, 20240502)]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of a multiplier and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, p: int) -> None:
        self.p, self.inverse = p, pow(p, -1, 1 << 64)
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = 1 << max(16, (n - 1).bit_length())
            with np.errstate(over="ignore"):
                steps = np.full(m, self.p, np.uint64)
                steps[0] = 1
                self.up = np.multiply.accumulate(steps)
                steps = np.full(m, self.inverse, np.uint64)
                steps[0] = 1
                self.down = np.multiply.accumulate(steps)
        return self.up[:n], self.down[:n]


POWERS = [_Powers(p) for p in _P]


#: Words that are hashed at a time; memory for a text beyond its bytes follows its words.
SEGMENT = 1 << 16


class Words:
    """The words of one text, with hashes of all runs of consecutive words.

    A run's hash is a polynomial over the bytes of its words joined by one space, so
    it depends on the word sequence alone.  64 bits: two different runs agree by chance with
    probability 2**-64; a second, independent hash makes that 2**-128 where whole corpora are compared.
    """

    __slots__ = ("buf", "ends", "n", "starts")

    def __init__(self, text: bytes | None, lower: bool = False):
        raw = np.frombuffer(text or b"", np.uint8)
        if lower:
            raw = _LOWER[raw]
        gap = _IS_SPACE[raw]
        keep = ~gap
        edge = np.flatnonzero(np.diff(np.concatenate(([0], keep.view(np.int8), [0]))))
        starts, ends = edge[0::2], edge[1::2]
        self.n = len(starts)
        # the normalised text: words with one space between
        last = np.zeros(len(raw) + 1, bool)
        last[ends] = True
        take = keep | (last[:-1] & gap)
        self.buf = np.where(gap, np.uint8(32), raw)[take]
        sizes = ends - starts
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes

    def runs(self, k: int, again: bool = False) -> np.ndarray:
        """Hashes of all runs of k words, by start; ``again``: by the second hash."""
        m = self.n - k + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        return self._hashes(0, m, k, again) if m <= SEGMENT else np.concatenate([self._hashes(lo, min(m, lo + SEGMENT), k, again) for lo in range(0, m, SEGMENT)])

    def _hashes(self, lo: int, hi: int, k: int, again: bool) -> np.ndarray:
        base = self.starts[lo]
        a, b = self.starts[lo:hi] - base, self.ends[lo + k - 1 : hi + k - 1] - base
        part = self.buf[base : base + b[-1]]
        up, down = POWERS[again].get(len(part) + 1)
        with np.errstate(over="ignore"):
            acc = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[again][part] * up[: len(part)], dtype=np.uint64)))
            return mix((acc[b] - acc[a]) * down[a] + (b - a).astype(np.uint64))

    def join(self, keep: np.ndarray) -> bytes:
        """The words kept, joined by one space."""
        if keep.all():
            return self.buf[: self.ends[-1]].tobytes() if self.n else b""
        b, s, e = self.buf.tobytes(), self.starts.tolist(), self.ends.tolist()
        # runs of kept words are contiguous slices
        edge = np.flatnonzero(np.diff(np.concatenate(([0], keep.astype(np.int8), [0]))))
        return b" ".join(b[s[i] : e[j - 1]] for i, j in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of the lower-cased text.

    Fewer than k words make one shingle of the whole sequence; no words make none.
    """
    w = Words(text, lower=True)
    return np.unique(w.runs(min(k, w.n))) if w.n else np.zeros(0, np.uint64)
