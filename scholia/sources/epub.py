"""EPUB files as HTML."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _plain(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def spine_html(content: bytes) -> str | None:
    """The documents of a book in reading order, one after another; None for what is no book."""
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        root = ElementTree.fromstring(book.read("META-INF/container.xml"))
        package = next(e.get("full-path") for e in root.iter() if _plain(e.tag) == "rootfile")
        spec = ElementTree.fromstring(book.read(package))
        where = {e.get("id"): e.get("href") for e in spec.iter() if _plain(e.tag) == "item"}
        names = [posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(where[e.get("idref")]))) for e in spec.iter() if _plain(e.tag) == "itemref" and e.get("idref") in where]
        have = set(book.namelist())
        return "\n".join(re.sub(r"^\ufeff?<\?xml[^>]*\?>\s*", "", book.read(n).decode("utf-8", "replace")) for n in names if n in have)
    except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError):
        return None


@F.pandas_udf(T.StringType())
def epub_html(content: pd.Series) -> pd.Series:
    """The HTML of books given as bytes; null for what can't be read."""
    return pd.Series([None if c is None else spine_html(bytes(c)) for c in content], dtype=object)
