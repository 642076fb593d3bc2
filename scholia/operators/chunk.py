"""Documents to overlapping chunks that know their page, lines and bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.schemas import PAGE_SEPARATOR

MAX_BYTES, OVERLAP_BYTES = 4000, 400
#: Characters of chunks that a task gathers before it hands them on.
GATHERED = 1 << 20
_NUMBERS = ("chunk_index", "total_chunks", "char_start", "char_end", "line_start", "line_end", "page")
_SPANS = [*[T.StructField(n, T.IntegerType()) for n in _NUMBERS], T.StructField("raw_text", T.StringType())]


def _next_char(b: bytes, i: int) -> int:
    i = min(i, len(b))
    while i < len(b) and b[i] & 0xC0 == 0x80:
        i += 1
    return i


def _windows(b: bytes, most: int, overlap: int):
    """Byte ranges of one page: whole if it fits, else windows that end at a break in their last fifth."""
    if len(b) <= most:
        yield 0, len(b)
        return
    at = 0
    while at < len(b):
        end = _next_char(b, at + most)
        if end < len(b):
            low = _next_char(b, end - (end - at) // 5)
            for mark in (b"\n\n", b". ", b"? ", b"! "):
                found = b.rfind(mark, low, end)
                if found >= 0:
                    end = found + len(mark)
                    break
        yield at, end
        back = _next_char(b, max(0, end - overlap))
        at = back if back > at else end


def chunk_spans(text: str, most: int = MAX_BYTES, overlap: int = OVERLAP_BYTES) -> list[tuple]:
    """(char_start, char_end, line_start, line_end, page, text): bytes half open, lines and pages from 1.

    A chunk's place is where its text first occurs in its page.
    """
    out, base = [], 0
    whole = text.encode()
    seen = lines = 0  # bytes from the start, and the line breaks in them
    for page, part in enumerate(text.split(PAGE_SEPARATOR), 1):
        b = part.encode()
        for i, j in _windows(b, most, overlap):
            chunk = b[i:j].decode(errors="ignore").strip()
            if chunk:
                raw = chunk.encode()
                start = base + max(0, b.find(raw))
                end = start + len(raw)
                # chunks come in order but for repeated text, so each byte is counted once or in a step back
                lines += whole.count(b"\n", seen, start) if start >= seen else -whole.count(b"\n", start, seen)
                seen, first = start, lines + 1
                out.append((start, end, first, max(first, first + whole.count(b"\n", start, max(start, end - 1))), page, chunk))
        base += len(b) + len(PAGE_SEPARATOR)
    return out


def _chunk_rows(most: int, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over doc_id, title and text: a row a chunk, some of them at a time, so that memory follows the longest text."""

    def batch(given: pa.RecordBatch, at: list[int], found: list[tuple]) -> pa.RecordBatch:
        *numbers, texts = zip(*found)
        own = [given.column(k).take(pa.array(at, pa.int64())) for k in range(2)]
        return pa.RecordBatch.from_arrays([*own, *[pa.array(n, pa.int32()) for n in numbers], pa.array(texts, pa.string())], names=["doc_id", "_title", *_NUMBERS, "raw_text"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            at, found, held = [], [], 0
            for row, text in enumerate(given.column(2)):
                spans = chunk_spans(text.as_py() or "", most, overlap)
                for k, (*place, chunk) in enumerate(spans):
                    at.append(row)
                    found.append((k, len(spans), *place, chunk))
                    held += len(chunk)
                    if held >= GATHERED:
                        yield batch(given, at, found)
                        at, found, held = [], [], 0
            if found:
                yield batch(given, at, found)

    return task


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None, most: int = MAX_BYTES, overlap: int = OVERLAP_BYTES) -> DataFrame:
    """doc_id, chunk_index, total_chunks, raw_text, text (with its header), char_start, char_end, line_start, line_end, page.

    A null or blank text has no chunks.  The index counts from 0 before any quality filter.
    """

    title = F.coalesce(F.col(title_col), F.col(id_col).cast("string")) if title_col else F.col(id_col).cast("string")
    given = docs.select(F.col(id_col).alias("doc_id"), title.alias("_title"), F.col(text_col).alias("_text"))
    # rows, not an array a document: whoever unpacked that would have Spark look for empty arrays first, and cut all texts twice
    kind = T.StructType([given.schema["doc_id"], given.schema["_title"], *_SPANS])
    rows = given.mapInArrow(_chunk_rows(most, overlap), kind)
    return rows.select(
        "doc_id", "chunk_index", "total_chunks", "raw_text", F.format_string("%s > chunk %d\n\n%s", "_title", "chunk_index", "raw_text").alias("text"),
        "char_start", "char_end", "line_start", "line_end", "page",
    )
