"""Media columns: texts as GIF images, decoded again to frames and colour histograms.

A payload becomes 8-bit samples of GIF frames, 64 samples wide, through real LZW code
streams; a payload beyond one frame's rows continues in timed frames.  The decoder reads
any GIF: local and global palettes, variable code widths, interlacing, transparency and
the disposal rules.  Code widths follow from a code's place in the stream alone, so codes
are unpacked in bulk; only the expansion of strings goes code by code.

Everything is one row in, one row out: no shuffle, and memory bounded by some megabytes of text, or one text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indexloom.llm.tokens import slices
from indexloom.llm.workers import python_map

WIDTH = 64
#: Rows of a frame, and hundredths of a second that it is shown.
ROWS, DELAY = 4096, 4
_CLEAR, _END = 256, 257
_GREY = bytes(v for g in range(256) for v in (g, g, g))

def _widths(bits: int, count: int) -> np.ndarray:
    """Widths of ``count`` codes that follow a clear code; codes start at ``bits + 1`` wide."""
    entries = (1 << bits) + 2 + np.maximum(0, np.arange(count) - 1)  # table size when code i is read
    return np.minimum(12, np.maximum(bits + 1, np.floor(np.log2(np.minimum(entries, 4095))).astype(np.int64) + 1))


_WIDTH_CACHE: dict[int, np.ndarray] = {}


def _widths_of(bits: int) -> np.ndarray:
    if bits not in _WIDTH_CACHE:
        _WIDTH_CACHE[bits] = _widths(bits, 4096 - (1 << bits))
    return _WIDTH_CACHE[bits]


def lzw_encode(data: bytes) -> bytes:
    """The LZW code stream of 8-bit samples; the table is cleared whenever it is full."""
    clear, end, full = _CLEAR, _END, 4095
    codes = [clear]
    add = codes.append
    if data:
        table: dict[int, int] = {}
        get = table.get
        size, code = 258, data[0]
        for b in memoryview(data)[1:]:
            key = code << 8 | b
            found = get(key)
            if found is not None:
                code = found
                continue
            add(code)
            code = b
            if size < full:
                table[key] = size
                size += 1
            else:
                add(clear)
                table.clear()
                size = 258
        add(code)
    add(end)
    return _packed(np.array(codes, np.int64))


def _packed(codes: np.ndarray) -> bytes:
    """Codes of an 8-bit stream as bits, least significant first."""
    n = len(codes)
    starts = np.flatnonzero(codes == _CLEAR)
    since = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))  # 0 at a clear code
    # a code read right after a clear code is number 0 of its run; the clear itself ends the run before
    number = since - 1
    table = _widths_of(8)
    width = np.where(number >= 0, table[np.minimum(np.maximum(number, 0), len(table) - 1)], 0)
    lengths = np.diff(np.append(starts, n))
    width[starts] = np.concatenate(([9], table[np.minimum(lengths[:-1] - 1, len(table) - 1)])) if len(starts) else width[starts]
    at = np.concatenate(([0], np.cumsum(width)[:-1]))
    total = int(at[-1] + width[-1]) if n else 0
    out = np.zeros((total + 7) // 8 + 3, np.uint8)
    low, bits = at >> 3, codes << (at & 7)
    # codes overlap in their border bytes: each byte position is hit by few codes, summed without carry
    for j in range(3):
        out[: len(out)] |= np.bincount(low + j, weights=(bits >> (8 * j)) & 255, minlength=len(out)).astype(np.uint8)
    return out[: (total + 7) // 8].tobytes()


def lzw_decode(data: bytes, bits: int = 8, most: int | None = None) -> bytes:
    """The samples of a code stream with ``bits``-bit samples; at most ``most`` of them.

    A stream may go on with a full table for as long as it likes; it ends at its end code or its last whole code.
    """
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(4, np.uint8))).astype(np.int64)
    limit, at = len(data) * 8, 0
    table = _widths_of(bits)
    ends = np.cumsum(table)
    out = bytearray()

    def read(place: np.ndarray, width: np.ndarray) -> tuple[list[int], int]:
        """Codes before the first clear or end code, and where that is (-1: not here)."""
        byte = place >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (place & 7)) & ((1 << width) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stop[0]) if len(stop) else len(codes)
        stopped[:] = [int(codes[n]), int(place[n] + width[n])] if len(stop) else []
        return codes[:n].tolist(), n if len(stop) else -1

    stopped: list[int] = []
    while at < limit and (most is None or len(out) < most):
        # codes until the next clear or end code: their places are known before they are read
        count = int(np.searchsorted(ends, limit - at, "right"))
        codes, n = read(at + ends[:count] - table[:count], table[:count])
        after = at + int(ends[-1])
        while n < 0 and count == len(table) and after + 12 <= limit:  # a full table is not cleared: codes stay 12 bits wide
            step = min((limit - after) // 12, 1 << 16)
            more, n = read(after + 12 * np.arange(step), np.full(step, 12))
            codes += more
            after += 12 * step
        _expand(codes, clear, out)
        if n < 0 or stopped[0] == end:
            break
        at = stopped[1]
    return bytes(out if most is None else out[:most])


def _expand(codes: list[int], clear: int, out: bytearray) -> None:
    """Appends the strings of a run of codes after a clear code."""
    if not codes:
        return
    strings = [bytes((i,)) for i in range(clear)] if clear != 256 else _BYTES.copy()
    strings += (b"", b"")
    add, size = strings.append, clear + 2
    last = strings[codes[0]]
    parts = [last]
    put = parts.append
    for c in codes[1:]:
        if c < size:
            now = strings[c]
        elif c == size:
            now = last + last[:1]
        else:
            raise ValueError("not a GIF code stream")
        put(now)
        if size < 4096:
            add(last + now[:1])
            size += 1
        last = now
    out += b"".join(parts)


_BYTES = [bytes((i,)) for i in range(256)]


def _blocks(data: bytes) -> bytes:
    """Data sub-blocks and their terminator."""
    return b"".join(bytes((len(p),)) + p for p in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def gif_encode(payload: bytes) -> bytes:
    """A GIF whose frames hold ``payload`` (a positive multiple of 64 bytes) as grey samples."""
    if not payload or len(payload) % WIDTH:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), _GREY]
    for top in range(0, rows, ROWS):
        part = payload[top * WIDTH : (top + ROWS) * WIDTH]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, DELAY, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08" + _blocks(lzw_encode(part)))
    out.append(b"\x3b")
    return b"".join(out)


class Frame:
    """One frame: where it lies, its samples, palette, transparent index, disposal and delay."""

    __slots__ = ("delay", "disposal", "h", "palette", "samples", "transparent", "w", "x", "y")


def frames(media: bytes) -> tuple[int, int, list[Frame]]:
    """Width, height and frames of any GIF."""
    if media[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", media, 6)
    at, shared = 13, b""
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        shared, at = media[at : at + n], at + n
    out, control = [], (0, 0, None)

    def sub_blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(media) and media[at]:
            parts.append(media[at + 1 : at + 1 + media[at]])
            at += 1 + media[at]
        if at >= len(media):
            raise ValueError("a GIF ends early")
        return b"".join(parts), at + 1

    while at < len(media) and media[at] != 0x3B:
        if media[at] == 0x21:
            body, after = sub_blocks(at + 2)
            if media[at + 1] == 0xF9 and len(body) >= 4:
                bits, delay, index = struct.unpack_from("<BHB", body)
                control = (bits >> 2 & 7, delay, index if bits & 1 else None)
            at = after
        elif media[at] == 0x2C:
            f = Frame()
            f.x, f.y, f.w, f.h, flags = struct.unpack_from("<HHHHB", media, at + 1)
            at += 10
            f.palette = shared
            if flags & 0x80:
                n = 3 << ((flags & 7) + 1)
                f.palette, at = media[at : at + n], at + n
            bits = media[at]
            data, at = sub_blocks(at + 1)
            samples = lzw_decode(data, bits, f.w * f.h)
            if len(samples) < f.w * f.h:
                raise ValueError("a GIF frame ends early")
            f.samples = np.frombuffer(samples, np.uint8).reshape(f.h, f.w)
            if flags & 0x40:  # four passes of rows
                order = np.concatenate([np.arange(a, f.h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
                f.samples = f.samples[np.argsort(order)]
            f.disposal, f.delay, f.transparent = control
            control = (0, 0, None)
            out.append(f)
        else:
            raise ValueError("not a GIF block")
    return width, height, out


def composed(media: bytes) -> Iterator[tuple[np.ndarray, Frame]]:
    """The pictures that a viewer shows (RGBA), by disposal and transparency, each with the frame drawn last."""
    width, height, parts = frames(media)
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in parts:
        before = canvas.copy() if f.disposal == 3 else None
        palette = np.zeros((256, 4), np.uint8)
        own = np.frombuffer(f.palette, np.uint8).reshape(-1, 3)
        palette[: len(own), :3], palette[: len(own), 3] = own, 255
        area = canvas[f.y : f.y + f.h, f.x : f.x + f.w]
        shown = f.samples[: area.shape[0], : area.shape[1]]
        if f.transparent is None:
            area[:] = palette[shown]
        else:
            seen = shown != f.transparent
            area[seen] = palette[shown][seen]
        yield canvas.copy(), f
        if f.disposal == 2:
            area[:] = 0
        elif before is not None:
            canvas = before


def drawn(picture: np.ndarray, f: Frame) -> np.ndarray:
    """The part of a picture that its frame drew."""
    return picture[f.y : f.y + f.h, f.x : f.x + f.w]


def gif_payload(media: bytes) -> bytes:
    """The red samples of what the frames drew, one after another: the payload of a GIF of ``gif_encode``."""
    return b"".join(drawn(p, f)[:, :, 0].tobytes() for p, f in composed(media))


#: Bins of a colour histogram.
BINS = 16


def histogram(samples: np.ndarray) -> np.ndarray:
    """Counts of one channel's levels in ``BINS`` equal bins."""
    return np.bincount(samples.ravel() >> (8 - BINS.bit_length() + 1), minlength=BINS)


def padded(text: bytes | None) -> bytes:
    """A text's bytes with zeros up to a positive multiple of 64."""
    raw = text or b""
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (the GIF).

    Null and empty texts give one row of zeros; repeated rows and null ids are rows of their own; an empty table gives
    an empty one; other columns are left out.  A very long text is many frames, encoded one after another.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, rows in slices(b.column(1), 8 << 20):
                texts = b.column(1).slice(lo, rows).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, rows), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([gif_encode(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(python_map, encode, "doc_id long, n_bytes long, media binary")


_FRAME = pa.struct([("delay_cs", pa.int32()), *[(c, pa.list_(pa.int64())) for c in ("red", "green", "blue")]])


def features(stored: DataFrame) -> DataFrame:
    """Reads stored media back: sizes, digests, and the timed frames with a colour histogram for each channel.

    ``frames``: of each frame the delay and the histograms of what it drew, as shown after disposal and transparency.
    ``feature``: frames, hundredths of a second and the histograms of all frames together.  Each row is on its own, whatever
    repeats; an empty table gives an empty one; columns besides doc_id, n_bytes and media are left out.
    """
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_cs int, frames array<struct<delay_cs: int, red: array<bigint>, green: array<bigint>, blue: array<bigint>>>"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for media in b.column(2).to_pylist():
                digest, size, tail, shots = hashlib.sha256(), 0, b"", []
                for picture, f in composed(media):
                    area = drawn(picture, f)
                    part = area[:, :, 0].tobytes()
                    digest.update(part)
                    size, tail = size + len(part), (tail + part)[-64:]
                    shots.append((f.delay, *[histogram(area[:, :, c]) for c in range(3)]))
                total = [sum(x[c] for x in shots) for c in (1, 2, 3)] if shots else [np.zeros(BINS, np.int64)] * 3
                wait = sum(x[0] for x in shots)
                feature = f"gif:{len(shots)}:{wait}:" + ";".join(",".join(map(str, t.tolist())) for t in total)
                timed = [{"delay_cs": d, "red": r.tolist(), "green": g.tolist(), "blue": u.tolist()} for d, r, g, u in shots]
                rows.append((size, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature, len(shots), wait, timed))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 9
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(_FRAME)]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_cs", "frames"]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names)

    return stored.select("doc_id", "n_bytes", "media").transform(python_map, decode, fields)
