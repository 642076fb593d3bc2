"""Edit distances of many texts at once, by bits of numbers, in Arrow batches."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of 64 characters that go on together, what a core's cache holds; words and letters of texts that a table holds.
LANES, TABLE = 4096, 1 << 22
#: Words of texts that meet one stream from which they go on as one whole number; characters of windows that do; characters below which bits are set one by one.
WIDE, WINDOWS, SHORT = 200, 1 << 18, 1000

Ask = tuple[str, str, int, list[int]]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32) + np.uint32(1)


def _words(text: str) -> int:
    return (len(text) + 63) // 64


def edits_of(asks: list[Ask]) -> list[list[int]]:
    """For each (text, stream, first, ends) the Levenshtein distances of the text to stream[first : first + end], for ends that ascend.

    Asks of many pages go on together, those of like length side by side; the many of one large page by their stream.
    """
    out = [[max(len(text), end) for end in ends] for text, _, _, ends in asks]
    same: dict[tuple, list[int]] = {}
    for n, (text, stream, first, ends) in enumerate(asks):
        if text and ends and ends[-1]:
            same.setdefault((stream, first, ends[-1]), []).append(n)
    some = []
    for (stream, first, last), group in same.items():
        if sum(_words(asks[n][0]) for n in group) < WIDE:
            some += group
            continue
        ends = sorted({e for n in group for e in asks[n][3]})
        edits = edits_along([asks[n][0] for n in group], stream[first : first + last], ends)
        for k, n in enumerate(group):
            out[n] = [edits[ends.index(e)][k] for e in asks[n][3]]
    some.sort()
    at, texts, size = 0, set(), 0
    for k, n in enumerate(some):
        if asks[n][0] not in texts:
            if texts and size + _words(asks[n][0]) > TABLE // 64:
                _fill(asks, some[at:k], out)
                at, texts, size = k, set(), 0
            texts.add(asks[n][0])
            size += _words(asks[n][0])
    _fill(asks, some[at:], out)
    return out


def _fill(asks: list[Ask], some: list[int], out: list[list[int]]) -> None:
    """The distances of some asks, from one table of the bits of their texts' letters."""
    if not some:
        return
    texts, streams = (list(dict.fromkeys(asks[n][k] for n in some)) for k in (0, 1))
    letters = len(set().union(*texts)) + 1
    if len(texts) > 1 and letters * sum(map(_words, texts)) > 2 * TABLE:
        # many letters: fewer texts at once
        half = set(texts[: len(texts) // 2])
        _fill(asks, [n for n in some if asks[n][0] in half], out)
        _fill(asks, [n for n in some if asks[n][0] not in half], out)
        return
    table = _table(texts, streams)
    rows = dict(zip(texts, np.cumsum([0, *map(_words, texts)]).tolist()))
    begins = dict(zip(streams, np.cumsum([0, *map(len, streams)]).tolist()))
    some = sorted(some, key=lambda n: (asks[n][3][-1], begins[asks[n][1]]))
    at = lanes = 0
    for k, n in enumerate([*some, None]):
        if n is None or lanes + _words(asks[n][0]) > LANES:
            chunk = sorted(some[at:k], key=lambda n: -asks[n][3][-1] - _words(asks[n][0]))
            for m, edits in zip(chunk, _together([(len(asks[m][0]), rows[asks[m][0]], begins[asks[m][1]] + asks[m][2], asks[m][3]) for m in chunk], *table)):
                out[m] = edits
            at, lanes = k, 0
        lanes += 0 if n is None else _words(asks[n][0])


def _table(texts: list[str], streams: list[str]) -> tuple[np.ndarray, int, np.ndarray]:
    """The bits of each letter in the words of the texts, the number of letters, and the letters of the streams, with 0 for others and behind them."""
    points = np.zeros(sum(map(_words, texts)) * 64, np.uint32)
    at = 0
    for t in texts:
        points[at : at + len(t)] = _points(t)
        at += _words(t) * 64
    letters = np.unique(points)
    letters = letters[letters > 0] if len(letters) > 1 else letters
    codes = np.where(points > 0, np.searchsorted(letters, points) + 1, 0).reshape(-1, 64)
    equal, rows = np.zeros((len(codes), len(letters) + 1), np.uint64), np.arange(len(codes))
    for b in range(64):
        equal[rows, codes[:, b]] |= np.uint64(1 << b)
    equal[:, 0] = 0
    flat = np.concatenate([*map(_points, streams), np.zeros(max(map(_words, texts)) + max(map(len, streams)), np.uint32)])
    near = np.minimum(np.searchsorted(letters, flat), len(letters) - 1)
    return equal.ravel(), len(letters) + 1, np.where(letters[near] == flat, near + 1, 0).astype(np.intp)


def _together(asks: list[tuple[int, int, int, list[int]]], equal: np.ndarray, letters: int, flat: np.ndarray) -> list[list[int]]:
    """The distances of asks as the lengths of their texts, their rows in the table, their places in the streams and their ends, longest first.

    A column of the dynamic program is two numbers of 64 bits for each word of a text, the
    places where it rises and falls (Myers, Hyyro).  A word is one step behind the word
    before it and takes its carries, so all words of all asks take a step at once.
    """
    sizes, rows, begins = (np.array([a[k] for a in asks]) for k in (0, 1, 2))
    words = (sizes + 63) // 64
    finish = np.array([a[3][-1] for a in asks]) + words - 1
    steps, lanes, heads = int(finish[0]), int(words.sum()), np.cumsum(words) - words
    base = (np.repeat(rows - heads, words) + np.arange(lanes)) * letters

    # a word's places are kept when it has met an end
    ask = np.repeat(np.arange(len(asks)), [len(a[3]) for a in asks])
    end = np.concatenate([a[3] for a in asks])
    met = np.repeat(np.arange(len(end)), np.where(end > 0, words[ask], 0))
    behind = np.arange(len(met)) - np.searchsorted(met, met)
    when = end[met] + behind
    at = np.argsort(when, kind="stable")
    met, kept, since = met[at], (heads[ask[met]] + behind)[at], np.searchsorted(when[at], np.arange(1, steps + 2)).tolist()
    rises, falls = np.zeros(len(met), np.uint64), np.zeros(len(met), np.uint64)

    one, top = np.uint64(1), np.uint64(63)
    rise, fall, equals, diagonal, up, down, carry_up, carry_down, next_up, next_down = (np.zeros(lanes, np.uint64) for _ in range(10))
    rise[:] = ~np.uint64(0)
    letter, next_letter, place = (np.zeros(lanes, np.intp) for _ in range(3))
    left, live = np.searchsorted(-finish, -np.arange(steps), side="left").tolist(), None
    for t in range(steps):
        if live is None or left[t] < 0.97 * live:
            live = left[t]
            n = int(heads[live - 1] + words[live - 1])
            state = rise, fall, equals, diagonal, up, down, carry_up, carry_down, next_up, next_down, letter, next_letter, place, base
            rise, fall, equals, diagonal, up, down, carry_up, carry_down, next_up, next_down, letter, next_letter, place, base = (a[:n] for a in state)
            first, reads = heads[:live], begins[:live] + t
        next_letter[1:] = letter[:-1]
        next_letter[first] = flat[reads]
        reads += 1
        letter, next_letter = next_letter, letter
        carry_up[first] = one
        carry_down[first] = 0
        np.add(base, letter, out=place)
        equal.take(place, out=equals, mode="clip")
        equals |= carry_down
        np.bitwise_and(equals, rise, out=diagonal)
        diagonal += rise
        diagonal ^= rise
        diagonal |= equals
        diagonal |= fall
        np.bitwise_or(diagonal, rise, out=up)
        np.invert(up, out=up)
        up |= fall
        np.bitwise_and(rise, diagonal, out=down)
        np.right_shift(up[:-1], top, out=next_up[1:])
        np.right_shift(down[:-1], top, out=next_down[1:])
        up <<= one
        up |= carry_up
        down <<= one
        down |= carry_down
        np.bitwise_or(diagonal, up, out=rise)
        np.invert(rise, out=rise)
        rise |= down
        np.bitwise_and(up, diagonal, out=fall)
        carry_up, next_up, carry_down, next_down = next_up, carry_up, next_down, carry_down
        i, j = since[t], since[t + 1]
        if i < j:
            rises[i:j], falls[i:j] = rise[kept[i:j]], fall[kept[i:j]]

    valid = np.full(lanes, ~np.uint64(0))
    valid[heads + words - 1] >>= (-sizes % 64).astype(np.uint64)
    change = np.bitwise_count(rises & valid[kept]).astype(np.int64) - np.bitwise_count(falls & valid[kept])
    edits = np.where(end > 0, end + np.bincount(met, change, len(end)).astype(np.int64), sizes[ask]).tolist()
    following = iter(edits)
    return [[next(following) for _ in a[3]] for a in asks]


def _masks(points: np.ndarray, letters: str) -> dict[str, int]:
    """For each letter the places where it stands, as the bits of a whole number."""
    return {c: int.from_bytes(np.packbits(points == p, bitorder="little").tobytes(), "little") for c, p in zip(letters, _points(letters))}


def _along(equal: dict[str, int], mask: int, starts: int, state: tuple[int, int], stream: str) -> tuple[int, int]:
    """The places where the column rises and falls, after the letters of a stream, for texts one behind another a clear bit apart that takes up the carries."""
    rises, falls = state
    for c in stream:
        eq = equal[c]
        across = (((eq & rises) + rises) ^ rises) | eq
        up = ((falls | (((across | rises) & mask) ^ mask)) << 1) | starts
        down = (rises & across) << 1
        eq |= falls
        rises = (down & mask) | (((eq | up) & mask) ^ mask)
        falls = up & eq
    return rises, falls


def edits_along(texts: list[str], stream: str, ends: list[int]) -> list[list[int]]:
    """The Levenshtein distances of each text to the stream's beginnings of the given lengths, which ascend.

    The column is two whole numbers for all texts, so a character of the stream is one
    step for all of them: for texts that are long together and meet the same stream.
    """
    offsets = list(accumulate((len(t) + 1 for t in texts), initial=0))
    equal = dict.fromkeys(stream[: ends[-1]], 0) if ends else {}
    if offsets[-1] < SHORT:
        for o, t in zip(offsets, texts):
            for i, c in enumerate(t, o):
                if c in equal:
                    equal[c] |= 1 << i
    else:
        points = np.zeros(offsets[-1], np.uint32)
        for o, t in zip(offsets, texts):
            points[o : o + len(t)] = _points(t)
        equal = _masks(points, "".join(equal))
    wholes = [(1 << len(t)) - 1 for t in texts]
    mask = starts = 0
    for o, w in zip(offsets, wholes):
        mask |= w << o
        starts |= (1 if w else 0) << o
    state, out, seen = (mask, 0), [], 0
    for end in ends:
        state, seen = _along(equal, mask, starts, state, stream[seen:end]), end
        out.append([end + ((state[0] >> o) & w).bit_count() - ((state[1] >> o) & w).bit_count() for o, w in zip(offsets, wholes)])
    return out


def window_edits(text: str, blocks: list[str], step: int, widths: list[list[int]]) -> list[list[np.ndarray]]:
    """For each block and each of its widths the Levenshtein distances of a text to the windows of that width, which begin at every step-th place.

    The widest window of a place holds the others as beginnings, and the text is the stream.
    """
    every = sorted(set().union(*widths))
    lane, offsets = every[-1] + 1, np.cumsum([0, *map(len, blocks)])
    points = np.concatenate([*map(_points, blocks), np.zeros(lane, np.uint32)])
    begins = [np.arange(0, len(b) - min(ws) + 1, step) for b, ws in zip(blocks, widths)]
    starts, edits = np.concatenate([o + x for o, x in zip(offsets, begins)]), []
    some, letters = max(WINDOWS // lane, 1), "".join(set(text))
    for at in range(0, len(starts), some):
        places = points[starts[at : at + some, None] + np.arange(lane)]
        places[:, -1] = 0
        bits = np.ones(places.shape, bool)
        bits[:, -1] = False
        mask = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        bits[:, 1:] = False
        first = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        state = _along(_masks(places.ravel(), letters), mask, first, (mask, 0), text)
        rises, falls = (np.unpackbits(np.frombuffer(x.to_bytes(bits.size // 8 + 1, "little"), np.uint8), count=bits.size, bitorder="little").reshape(bits.shape).view(np.int8) for x in state)
        edits.append(len(text) + np.cumsum(rises - falls, axis=1, dtype=np.int32)[:, np.array(every) - 1])
    edits, ends = np.concatenate(edits), np.cumsum([0, *map(len, begins)])
    return [[edits[o : o + (len(b) - w) // step + 1, every.index(w)] for w in ws] for o, b, ws in zip(ends, blocks, widths)]


def matrices(pages: list[tuple[list[str], list[str]]]) -> list[list[list[int]]]:
    """For each pair of lists the Levenshtein distances of each text of one (rows) to each of the other."""
    edits = iter(edits_of([(x, y, 0, [len(y)]) for a, b in pages for x in a for y in b]))
    return [[[next(edits)[0] for _ in b] for _ in a] for a, b in pages]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def edit_matrix(a: pd.Series, b: pd.Series) -> pd.Series:
    """The Levenshtein distances of each text of one array (rows) to each of the other; null where an array is."""
    some = [n for n, (x, y) in enumerate(zip(a, b)) if x is not None and y is not None]
    out = [None] * len(a)
    for n, matrix in zip(some, matrices([(list(a.iat[n]), list(b.iat[n])) for n in some])):
        out[n] = matrix
    return pd.Series(out, dtype=object)


# else a projection that reads the distances inside a lambda is merged with the one that has them, where Python can't be called
edit_matrix = edit_matrix.asNondeterministic()
