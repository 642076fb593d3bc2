"""Substring dedup by content-defined chunking with a gear rolling hash.

The gear hash of the 16 bytes before a word decides whether the word begins a chunk,
so an insertion moves only the boundaries beside it and the same passage gives the same
chunks in any document.  From each chunk on, the fewest neighbouring chunks that together
have `min_words` words are a sequence, compared by a 64-bit digest of its chunks' bytes.  A
sequence that occurred before as a whole, by (doc_id, position), is a duplicate; chunks
that merely occurred somewhere are none.  Duplicate sequences that overlap or touch make a
repeated passage, which goes from all places but its first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.rows import other_names, packed
from scholia.llm.staging import settled, staged
from scholia.llm.textvec import mix64, sequence_hashes, slices, span_hashes, text_buffer, word_bounds

#: One word start in so many begins a chunk.
MEAN_WORDS = 4
#: A chunk without a boundary is cut after so many words.
MAX_WORDS = 64
#: Words of the neighbouring chunks that are compared together.  The chunks that
#: hold the two ends of a passage differ from place to place, so that a passage of 50
#: words shows as a run of some 40.
MIN_WORDS = 25

_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)
_WINDOW = 16
_LIMIT = np.uint16(65536 // MEAN_WORDS)


def gear(buf: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[b[i-k]] << k over the last 16 bytes, modulo 2**16.

    Shifting left by one and adding the next byte's value is the rolling form; the
    window doubles four times here instead, so that numpy can do all bytes at once.
    """
    h = _GEAR[buf]
    for k in (1, 2, 4, 8):
        if len(h) > k:
            h[k:] = h[k:] + (h[:-k] << np.uint16(k))
    return h


def chunk_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte, text index and number of words of each chunk."""
    start, end, doc = word_bounds(buf, off)
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    first = np.ones(len(start), bool)
    first[1:] = doc[1:] != doc[:-1]
    cut = first | ((gear(buf)[np.maximum(start - 1, 0)] < _LIMIT) & (start - off[doc] >= _WINDOW))
    at = np.flatnonzero(cut)
    length = np.diff(np.append(at, len(start)))
    if length.max(initial=0) > MAX_WORDS:
        word = np.arange(len(start)) - np.repeat(at, length)
        at = np.flatnonzero(word % MAX_WORDS == 0)
        length = np.diff(np.append(at, len(start)))
    return start[at], end[at + length - 1], doc[at], length


def sequences(doc: np.ndarray, words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last chunk of the shortest sequence of at least min_words words from each chunk; none at a text's end."""
    total = np.cumsum(words)
    last = np.searchsorted(total, total - words + min_words, "left")
    at = np.flatnonzero(last < len(doc))
    at = at[doc[last[at]] == doc[at]]
    return at, last[at]


def _chunks(full: bool, min_words: int):
    """(doc_id, text, text_hash) to the sequences (digest, doc_id, pos), in full with text_hash, last, begin, end, words_before and words_to.

    begin and end count code points; pos and last count chunks; words_before and words_to
    are the text's words up to the sequence and to its end.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            for i, j in slices(batch.column(1)):
                buf, off = text_buffer(batch.column(1).slice(i, j - i))
                begin, end, doc, words = chunk_bounds(buf, off)
                if not len(begin):
                    continue
                at, last = sequences(doc, words, min_words)
                if not len(at):
                    continue
                digest = sequence_hashes(span_hashes(buf, begin, end), at, last)
                first = np.searchsorted(doc, doc, "left")
                pos = (np.arange(len(doc)) - first).astype(np.int32)
                cols = [pa.array(digest.view(np.int64)), pa.array(ids[i:j][doc[at]]), pa.array(pos[at])]
                names = ["digest", "doc_id", "pos"]
                if full:
                    points = np.zeros(len(buf) + 1, np.int64)
                    np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
                    base = points[off[doc]][at]
                    total = np.cumsum(words)
                    before = total - words
                    own = before[first][at]
                    cols += [batch.column(2).slice(i, j - i).take(pa.array(doc[at])), pa.array(pos[last])] + [pa.array(x.astype(np.int32)) for x in (points[begin[at]] - base, points[end[last]] - base, before[at] - own, total[last] - own)]
                    names += ["text_hash", "last", "begin", "end", "words_before", "words_to"]
                for a in range(0, len(at), 1 << 16):
                    yield pa.RecordBatch.from_arrays([c.slice(a, 1 << 16) for c in cols], names=names)

    return task


def _passages(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """repeated_passages with the hash of the text that each is in."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.hash(text_col).alias("text_hash"))
    places = rows.select("doc_id", "text").mapInArrow(_chunks(False, min_words), "digest long, doc_id long, pos int")
    repeated = staged(
        places.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))
        .where("n > 1")
        .select("digest", F.col("first.doc_id").alias("first_doc_id"), F.col("first.pos").alias("first_pos")),
        "digests",
    )
    again = (
        rows.mapInArrow(_chunks(True, min_words), "digest long, doc_id long, pos int, text_hash int, last int, begin int, end int, words_before int, words_to int")
        .join(repeated.hint("merge"), "digest")
        .where("doc_id <> first_doc_id OR pos <> first_pos")
        .select("doc_id", "text_hash", "pos", "last", "begin", "end", "words_before", "words_to", "first_doc_id")
    )
    by_doc = Window.partitionBy("doc_id", "text_hash").orderBy("pos")
    so_far = F.max("last").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    return (
        again.withColumn("apart", F.when(F.col("pos") <= so_far + 1, 0).otherwise(1))
        .withColumn("run", F.sum("apart").over(by_doc))
        .groupBy("doc_id", "text_hash", "run")
        .agg(
            F.min("begin").cast("long").alias("begin"),
            F.max("end").cast("long").alias("end"),
            (F.max("words_to") - F.min("words_before")).cast("long").alias("n_words"),
            (F.max("last") - F.min("pos") + 1).cast("long").alias("n_chunks"),
            F.min("first_doc_id").alias("first_doc_id"),
        )
        .drop("run")
    )


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The repeated passages: doc_id, begin, end, n_words, n_chunks, first_doc_id.

    begin and end are code points of the text, end exclusive; they are ends of chunks, so
    up to a chunk at each end of what repeats stays outside.  first_doc_id is the smallest
    id that holds a sequence of the passage first.  A passage also counts if it repeats
    within one document.  Texts of fewer than min_words words have no sequences, and a row
    without an id takes no part.  Repeated rows of one id and text count as one place; of
    one id with other texts each has its own passages, and what lies at the same place of
    both is no repeat.
    """
    return _passages(docs, min_words, id_col, text_col).drop("text_hash")


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the spans (begin, end), which are sorted and apart; the parts are joined as they are."""
    parts = F.transform(
        spans,
        lambda s, i: F.substring(text, F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"]).cast("int") + 1, (s["begin"] - F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])).cast("int")),
    )
    rest = F.substring(text, F.element_at(spans, -1)["end"].cast("int") + 1, F.length(text))
    return F.concat(F.array_join(parts, ""), rest)


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, with repeated passages cut from the text, and n_cut (long), the code points cut.

    Of each passage the first place stays, by (id, position).  A text may become empty;
    null texts stay null with n_cut 0, as do all texts of rows without an id.  A column of
    docs that is called n_cut, in any case, is replaced.
    """

    def spans_of_docs() -> DataFrame:
        spans = _passages(docs, min_words, id_col, text_col).groupBy("doc_id", "text_hash")
        return spans.agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))

    spans = settled(docs.sparkSession, spans_of_docs, "spans")
    names = other_names(docs, ("n_cut",))
    rows = docs.select(packed(docs, ("n_cut",)).alias("row"))
    ident, text = F.col("row")[id_col], F.col("row")[text_col]
    # merged at every size: the spans grow with the documents, and a broadcast would fit small inputs alone
    found = rows.where(ident.isNotNull()).join(spans.hint("merge"), (ident.cast("long") == F.col("doc_id")) & (F.hash(text) == F.col("text_hash")), "left").select("row", "spans")
    found = found.unionByName(rows.where(ident.isNull()).withColumn("spans", F.lit(None).cast(found.schema["spans"].dataType)))
    n_cut = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["begin"])
    left = F.when(F.col("spans").isNull(), text).otherwise(without_spans(text, F.col("spans")))
    return found.select(*[left.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names], F.coalesce(n_cut, F.lit(0)).alias("n_cut"))
