"""Vectorised text helpers for Arrow batches: words, word hashes and shingles of whole texts.

A *word* is a maximal run of bytes other than space and the control characters
9 to 13.  Everything here works on one Arrow string array at a time, slice by
slice, so that memory follows the slice (a few MB, or one text if longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
SLICE_BYTES = 4 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words that spreads every bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=_U) * _BASE)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int, inverse: bool) -> np.ndarray:
    """The first n powers of the base (or of its inverse) modulo 2**64."""
    name = "inv" if inverse else "pow"
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.full(size, _BASE_INV if inverse else _BASE, dtype=_U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[name] = have
    return have[:n]


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and the n + 1 offsets; null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, off, data = texts.buffers()
    if off is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(off, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that together cover the array, each of about `most` bytes or of one text."""
    _, off = text_buffer(texts)
    i = 0
    while i < len(texts):
        j = int(np.searchsorted(off, off[i] + most, "right")) - 1
        j = min(max(j, i + 1), len(texts))
        yield i, j
        i = j


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of its text."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    white = WHITE[buf]
    first = np.empty(len(buf), bool)
    first[0] = True
    first[1:] = white[:-1]
    first[off[:-1][off[:-1] < len(buf)]] = True
    last = np.empty(len(buf), bool)
    last[-1] = True
    last[:-1] = white[1:]
    last[off[1:][off[1:] > 0] - 1] = True
    word = ~white
    start = np.flatnonzero(word & first)
    end = np.flatnonzero(word & last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are in order and don't overlap."""
    out = np.empty(len(start), dtype=_U)
    i = 0
    while i < len(start):
        a = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, a + SLICE_BYTES, "right")))
        b = int(end[j - 1])
        sums = np.zeros(b - a + 1, dtype=_U)
        np.cumsum(_BYTE[buf[a:b]] * _power_table(b - a, False), out=sums[1:])
        s, e = start[i:j] - a, end[i:j] - a
        value = (sums[e] - sums[s]) * _power_table(b - a + 1, True)[s]
        out[i:j] = mix64(value + (e - s).astype(_U))
        i = j
    return out


def string_hashes(texts: list[str]) -> np.ndarray:
    """A 64-bit hash of each string."""
    buf, off = text_buffer(pa.array(texts, pa.string()))
    return span_hashes(buf, off[:-1], off[1:])


def sequence_hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[first..last] of each pair; pairs are in order of both and may overlap."""
    out = np.empty(len(first), dtype=_U)
    i = 0
    while i < len(first):
        a = int(first[i])
        j = max(i + 1, int(np.searchsorted(last, a + SLICE_BYTES, "left")))
        b = int(last[j - 1]) + 1
        sums = np.zeros(b - a + 1, dtype=_U)
        np.cumsum(values[a:b] * _power_table(b - a, False), out=sums[1:])
        s, e = first[i:j] - a, last[i:j] + 1 - a
        out[i:j] = mix64((sums[e] - sums[s]) * _power_table(b - a + 1, True)[s] + (e - s).astype(_U))
        i = j
    return out


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    out = buf.copy()
    upper = (out >= 65) & (out <= 90)
    out[upper] += 32
    return out


_COEF = mix64(np.arange(101, 133, dtype=_U)) | _U(1)


def shingles(buf: np.ndarray, off: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of each text, and the index of their text.

    A text of fewer than n words, but at least one, has one shingle: all its words.
    """
    start, end, doc = word_bounds(buf, off)
    words = span_hashes(buf, start, end)
    count = np.bincount(doc, minlength=len(off) - 1) if len(doc) else np.zeros(len(off) - 1, np.int64)
    full = len(words) - n + 1
    if full > 0:
        at = np.flatnonzero(doc[:full] == doc[n - 1 :])
        total = np.zeros(len(at), dtype=_U)
        for k in range(n):
            total += words[at + k] * _COEF[k]
        out, owner = mix64(total), doc[at]
    else:
        out, owner = np.zeros(0, dtype=_U), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        begin = np.searchsorted(doc, short, "left")
        extra = np.zeros(len(short), dtype=_U)
        for k in range(n - 1):
            has = count[short] > k
            extra[has] += words[begin[has] + k] * _COEF[k]
        extra = mix64(extra + count[short].astype(_U))
        order = np.argsort(np.concatenate([owner, short]), kind="stable")
        out, owner = np.concatenate([out, extra])[order], np.concatenate([owner, short])[order]
    return out, owner
