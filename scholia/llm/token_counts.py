"""Token counts of a byte-level BPE tokenizer by the whole-token shortcut.

Most pre-tokens are themselves one token.  Which strings of the vocabulary encode alone as
one token is proved beforehand, by encoding each of them; texts are then cut into
pre-tokens by array operations, the proved ones count one each, and only the others are
merged, once for each that a worker meets anew.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.textvec import slices, span_hashes, string_hashes, text_buffer

#: Bytes of text counted at once; the working arrays take about a hundred times as much.
SLICE_BYTES = 1 << 17
#: Pre-tokens that a worker remembers, as a power of two.
CACHE_BITS = 20

OTHER, LETTER, NUMBER, SPACE = range(4)


def point_classes() -> tuple[np.ndarray, np.ndarray]:
    """Where the classes of code points change, and the class from there on, by the library's own Unicode tables."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    # unassigned, private and surrogate points are neither letters, numbers nor spaces
    points = np.array([c for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")])
    text = "".join(map(chr, points.tolist()))
    kind = np.zeros(0x110000, np.uint8)
    for value, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for _, (a, b) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            kind[points[a:b]] = value
    at = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
    return at, kind[at]


def pretoken_starts(points: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pre-tokens begin, as a mask over code points; first marks the beginnings of texts.

    The pre-tokens are: the contractions 's 't 're 've 'm 'll 'd; runs of letters, of
    numbers or of other characters, each with one space before it if there is one; and
    white space, of which the last character stays apart if a text goes on behind it.
    """
    n = len(points)
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    last = np.ones(n, bool)
    last[:-1] = run[1:]
    goes_on = np.zeros(n, bool)
    goes_on[:-1] = ~first[1:]
    start = run.copy()
    start[(kind == SPACE) & last & goes_on] = True
    joined = np.zeros(n, bool)
    joined[1:] = run[1:] & (kind[1:] != SPACE) & (points[:-1] == 0x20) & ~first[1:]
    start[joined] = False
    i = np.flatnonzero((points == 0x27) & run & last & start & goes_on)
    i = i[kind[i + 1] == LETTER]
    if len(i):
        c1 = points[i + 1]
        two = np.minimum(i + 2, n - 1)
        same = (i + 2 < n) & ~first[two] & (kind[two] == LETTER)
        c2 = np.where(same, points[two], 0)
        one = np.isin(c1, [ord(c) for c in "stmd"])
        pair = ~one & (((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l"))))
        for hit, length in ((one, 1), (pair, 2)):
            at = i[hit]
            start[at + 1] = False
            rest = at + 1 + length
            rest = rest[rest < n]
            start[rest[(kind[rest] == LETTER) & ~first[rest]]] = True
    return start


def load_tokenizer(path: str):
    """The tokenizer of a byte-level BPE file without normalisation, and its special strings; others raise ValueError."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer") or spec["model"].get("dropout"):
        raise ValueError("the shortcut is proved for plain byte-level BPE only")
    added = spec.get("added_tokens", [])
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("special strings that look at their neighbours are not supported")
    return Tokenizer.from_file(path), [t["content"] for t in added]


def proved_strings(path: str) -> list[str]:
    """The strings of the vocabulary that encode alone as one token, each shown by encoding it."""
    tok, special = load_tokenizer(path)
    ids = sorted(tok.get_vocab(with_added_tokens=False).values())
    texts = [tok.decode([i], skip_special_tokens=False) for i in ids]
    found = tok.encode_batch(texts, add_special_tokens=False)
    return [t for t, i, e in zip(texts, ids, found) if e.ids == [i] and t not in special]


class Counter:
    """Counts tokens of whole texts; one for each worker process, so that its memory of merged pre-tokens lasts."""

    def __init__(self, path: str, proved: np.ndarray, classes: tuple[np.ndarray, np.ndarray]):
        self.tok, self.special = load_tokenizer(path)
        at, kind = classes
        self.classes = np.repeat(kind, np.diff(np.append(at, 0x110000)))
        self.proved = proved  # sorted
        self.keys = np.zeros(1 << CACHE_BITS, np.uint64)
        self.counts = np.zeros(1 << CACHE_BITS, np.int32)

    def _pieces(self, buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token."""
        key = span_hashes(buf, begin, end)
        slot = (key >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        hit = self.keys[slot] == key
        out = np.where(hit, self.counts[slot], 0).astype(np.int64)
        miss = np.flatnonzero(~hit)
        if len(miss):
            kinds, one, back = np.unique(key[miss], return_index=True, return_inverse=True)
            n = np.ones(len(kinds), np.int32)
            at = np.minimum(np.searchsorted(self.proved, kinds), len(self.proved) - 1)
            rest = np.flatnonzero(self.proved[at] != kinds)
            if len(rest):
                where = miss[one[rest]]
                texts = [buf[a:b].tobytes().decode() for a, b in zip(begin[where].tolist(), end[where].tolist())]
                n[rest] = [len(e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
            out[miss] = n[back]
            where = (kinds >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
            self.keys[where], self.counts[where] = kinds, n
        return out

    def _specials(self, data: bytes, off: np.ndarray) -> np.ndarray:
        """The spans of the special strings in the texts, in order."""
        found, taken = [], np.zeros(len(data), bool)
        for mark in sorted((s.encode() for s in self.special), key=len, reverse=True):
            i = data.find(mark)
            while i >= 0:
                j = i + len(mark)
                # no span over the border of two texts, and none inside a longer one
                if np.searchsorted(off, i, "right") == np.searchsorted(off, j - 1, "right") and not taken[i:j].any():
                    taken[i:j] = True
                    found.append((i, j))
                i = data.find(mark, j)
        return np.array(sorted(found), np.int64).reshape(-1, 2)

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; texts longer than a slice are counted part by part."""
        buf, off = text_buffer(texts)
        out = np.zeros(len(off) - 1, np.int64)
        for i, j in slices(texts, SLICE_BYTES):
            if off[j] - off[i] <= SLICE_BYTES:
                out[i:j] = self._count(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                continue
            begin, size, most = int(off[i]), SLICE_BYTES, int(off[j])
            while begin < most:
                end = min(most, begin + size)
                if end < most:
                    end = begin + self._cut(buf[begin:end])
                if end == begin:
                    size *= 2  # one pre-token, or one special string, of this length
                    continue
                out[i] += self._count(buf[begin:end], np.array([0, end - begin]))[0]
                begin, size = end, SLICE_BYTES
        return out

    def _cut(self, part: np.ndarray) -> int:
        """The last place in a part of a text where a pre-token begins whatever comes before and after, or 0.

        A run of letters or of numbers ends before any other character, any run ends before
        white space, and a special string ends.  None may lie across the place.
        """
        lead = np.flatnonzero((part & 0xC0) != 0x80)[:-1]  # the part's end may cut the last character
        if len(lead) < 2:
            return 0
        data = part.tobytes()
        kind = self.classes[np.frombuffer(data[: lead[-1]].decode().encode("utf-32-le"), np.uint32)]
        safe = np.zeros(len(part) + 1, bool)
        safe[lead[1:-1]] = (kind[:-1] != kind[1:]) & ((kind[:-1] == LETTER) | (kind[:-1] == NUMBER) | (kind[1:] == SPACE))
        for i, j in self._specials(data, np.array([0, len(data)])).tolist():
            safe[i + 1 : j] = False
            safe[j] = True
        # a special string that the part's end cuts isn't seen
        longest = max((len(s.encode()) for s in self.special), default=0)
        at = np.flatnonzero(safe[: max(0, len(data) - longest + 1)])
        return int(at[-1]) if len(at) else 0

    def _count(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        out = np.zeros(len(off) - 1, np.int64)
        if not len(buf):
            return out
        data = buf.tobytes()
        special = self._specials(data, off)
        sections = np.concatenate([off[:-1], special.ravel()])
        lead = np.flatnonzero((buf & 0xC0) != 0x80)
        points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        first = np.zeros(len(points), bool)
        first[np.searchsorted(lead, sections[sections < len(buf)])] = True
        begin = lead[np.flatnonzero(pretoken_starts(points, self.classes[points], first))]
        end = np.append(begin[1:], len(buf))
        out += np.bincount(np.searchsorted(off, special[:, 0], "right") - 1, minlength=len(out))
        if len(special):
            at = np.searchsorted(special[:, 0], begin, "right") - 1
            use = (at < 0) | (begin >= special[at, 1])
            begin, end = begin[use], end[use]
        doc = np.searchsorted(off, begin, "right") - 1
        return out + np.bincount(doc, weights=self._pieces(buf, begin, end), minlength=len(out)).astype(np.int64)


_counters: dict[str, Counter] = {}


def worker_counter(path: str, proved: np.ndarray, classes: tuple[np.ndarray, np.ndarray]) -> Counter:
    """This process's counter for a tokenizer; the library keeps to one thread, as Spark fills the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _counters:
        _counters.clear()
        _counters[path] = Counter(path, proved, classes)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens (long) and over_limit (n_tokens > limit) for every row.

    `path` names the tokenizer's file on every machine.  Counts are those of the library
    without added special tokens; a special string inside a text is its special token.
    Memory follows the slices that are counted at once, not the longest text, but for a
    single pre-token of more than a slice.  A null or empty text has 0 bytes and 0 tokens.
    Null ids and repeated rows are kept.  An empty table gives an empty result; other
    columns are ignored.

    The proved strings go to the workers as 64-bit hashes, bounded by the vocabulary, and
    the classes of code points as some thousand ranges.
    """
    proved = np.unique(string_hashes(proved_strings(path)))
    classes = point_classes()

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counter = worker_counter(path, proved, classes)
            texts = batch.column(1)
            _, off = text_buffer(texts)
            n = counter.count(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(task, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
