"""Token ids of whole texts, encoded by the tokenizers library inside Python workers.

A vocabulary whose pipeline normalises and splits at white space gives a text the ids of its
white-space-separated words, one after another.  For such a pipeline (it is compared with the
one known, `PIPELINE`) texts are encoded some megabytes at a time: Arrow splits them, each distinct
word is taken apart into lower-case letters and the marks behind them, and numpy puts the ids of
the pieces together.  Each worker keeps a bounded table of pieces; new ones go to the library's
model, words of another form through the whole pipeline.  Other vocabularies are used on whole texts.
"""

from __future__ import annotations

import json
import os
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of one generation of a worker's table; two generations are kept.
KEEP = 500_000
#: Bytes of text that are encoded together.
CHUNK = 4 << 20
#: The pipeline for which words are independent of each other.
PIPELINE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
#: ASCII marks that are one piece behind a word's letters: all but those of contractions and special tokens.
_TAIL = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<>|")
#: Marks behind a word that are looked at, in bytes.
_LONGEST = 8
#: Words of letters below U+0100, which are one piece in composed form.
_PLAIN = "^[" + "".join(f"\\x{{{ord(c):x}}}" for c in map(chr, range(256)) if c.isalpha()) + "]*$"
#: White space for Arrow and str.split alone; texts with these are encoded whole.
_ODD = "\x1c\x1d\x1e\x1f"
_ENCODERS: dict[str, Encoder] = {}


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where printable."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


def _bytes_of(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    a = array("I", ids)
    if sys.byteorder != "little":
        a.byteswap()
    return a.tobytes()


def _strings(a: pa.Array) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()


def _put_together(entries: list[bytes], code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the entries named by ``code``, one after another, and where each ends."""
    sizes = np.fromiter(map(len, entries), np.int64, len(entries)) >> 2
    first = np.cumsum(sizes) - sizes
    return _gather(np.frombuffer(b"".join(entries), "<u4"), first, sizes, code)


def _gather(ids: np.ndarray, first: np.ndarray, sizes: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = sizes[code]
    ends = np.cumsum(size)
    at = np.repeat(first[code] - (ends - size), size)
    at += np.arange(len(at))
    return ids[at], ends


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        made = json.loads(self.tok.to_str())
        self.by_word = all(made[k] == v for k, v in PIPELINE.items())
        self.bytes = _byte_characters()
        self.pieces: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        """Through the whole pipeline."""
        return _bytes_of(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _pieces(self, letters: list[str]) -> list[bytes]:
        """The ids of distinct pieces: lower-case letters, or marks, by the model."""
        found = list(map(self.pieces.get, letters))
        if None in found:
            if len(self.pieces) >= KEEP:
                self.pieces, self.older = {"": b""}, self.pieces
            known, tokenize = self.older.get, self.model.tokenize
            for i, ids in enumerate(found):
                if ids is None:
                    s = letters[i]
                    ids = known(s)
                    if ids is None:
                        ids = _bytes_of([t.id for t in tokenize(s if s.isascii() else s.encode().decode("latin-1").translate(self.bytes))])
                    found[i] = self.pieces[s] = ids
        return found

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one after another, and where each ends."""
        n = len(words)
        core = pc.utf8_rtrim(words, characters=_TAIL)
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        ends = offsets[1:]
        marks = ends - offsets[:-1] - pc.binary_length(core).to_numpy(zero_copy_only=False)
        plain = pc.match_substring_regex(core, _PLAIN).to_numpy(zero_copy_only=False) & (marks <= _LONGEST)
        letters = pc.if_else(pa.array(plain), pc.utf8_lower(core), "").dictionary_encode()
        # the marks as numbers, byte by byte from the end
        key = np.zeros(n, np.uint64)
        for k in range(_LONGEST):
            at = np.flatnonzero(plain & (marks > k))
            key[at] |= data[ends[at] - 1 - k].astype(np.uint64) << np.uint64(8 * k)
        tails, tail = np.unique(key, return_inverse=True)
        other = np.flatnonzero(~plain)
        cores = _strings(letters.dictionary)
        entries = self._pieces(cores) + self._pieces([int(t).to_bytes(_LONGEST, "big").lstrip(b"\0").decode() for t in tails])
        code = np.empty((n, 2), np.int64)
        code[:, 0] = letters.indices.to_numpy(zero_copy_only=False)
        code[:, 1] = len(cores) + tail
        code[other, 0] = len(entries) + np.arange(len(other))
        entries += [self.whole(w) for w in _strings(words.take(pa.array(other)))]
        ids, at = _put_together(entries, code.ravel())
        return ids, at[1::2]

    def encode(self, text: str | None) -> bytes:
        return self.encode_many(pa.array([text], pa.string()))[0].tobytes()

    def encode_many(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none), each text's followed by ``end_id``, and where each text's begin.

        The last entry of the second array is the number of ids.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.by_word:
            alone = np.arange(len(texts))
        else:
            alone = np.flatnonzero(pc.match_substring_regex(texts, f"[{_ODD}]").to_numpy(zero_copy_only=False))
        own = [self.whole(t) if t else b"" for t in _strings(texts.take(pa.array(alone)))]
        if len(alone):
            apart = np.zeros(len(texts), bool)
            apart[alone] = True
            texts = pc.if_else(pa.array(apart), "", texts)
        split = pc.utf8_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        ids, word_ends = self._words(coded.dictionary)
        # what a text is made of: its words, or itself, then the end
        more = own + ([] if end_id is None else [_bytes_of([end_id])])
        ids = np.concatenate((ids, np.frombuffer(b"".join(more), "<u4")))
        all_ends = np.concatenate((word_ends, (word_ends[-1] if len(word_ends) else 0) + np.cumsum([len(x) // 4 for x in more], dtype=np.int64)))
        sizes = np.diff(all_ends, prepend=0)
        parts = np.diff(split.offsets.to_numpy()).astype(np.int64) + (end_id is not None)
        parts[alone] += 1
        ends = np.cumsum(parts)
        code = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        plain = np.ones(len(code), bool)
        last = ends - 1
        if end_id is not None:
            code[last], plain[last] = len(sizes) - 1, False
            last = last - 1
        code[last[alone]], plain[last[alone]] = len(word_ends) + np.arange(len(alone)), False
        code[plain] = coded.indices.to_numpy(zero_copy_only=False)
        out, at = _gather(ids, all_ends - sizes, sizes, code)
        return out, np.concatenate(([0], at))[np.concatenate(([0], ends))]


def slices(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """(first, rows) of consecutive rows with about ``size`` bytes of text together, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
        yield lo, hi - lo
        lo = hi


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
