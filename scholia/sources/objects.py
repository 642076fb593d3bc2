"""Objects of a store written, looked for and deleted by key, in the tasks that hold the keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import sharded_key


def _store(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def _each(rows: DataFrame, root: str, act: Callable) -> DataFrame:
    """(key, outcome) of act(store, path, *other columns) for each row (key, ...); equal keys go to one task."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(root)
        for batch in batches:
            outcomes = [act(store, f"{base}/{row[0]}", *row[1:]) for row in batch.itertuples(index=False)]
            yield pd.DataFrame({"key": batch["key"], "outcome": outcomes})

    return rows.where("key IS NOT NULL").repartition("key").mapInPandas(task, "key string, outcome string")


def _put(store, path: str, content: bytes) -> str:
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    beside = f"{folder}/.{name}.part"
    with store.open_output_stream(beside) as out:
        out.write(bytes(content))
    store.move(beside, path)
    return "put"


def _delete(store, path: str) -> str:
    try:
        store.delete_file(path)
    except FileNotFoundError:
        return "missing"
    return "deleted"


def _look(store, path: str) -> str:
    from pyarrow import fs

    return "missing" if store.get_file_info(path).type == fs.FileType.NotFound else "there"


def put_objects(rows: DataFrame, root: str) -> DataFrame:
    """Write the objects (key, content binary) below root; a key that is there is replaced, and never half written.

    Of several contents for a key, any one stays.
    """
    return _each(rows.select("key", F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content")), root, _put)


def delete_objects(keys: DataFrame, root: str) -> DataFrame:
    """Delete the objects of keys (key); (key, outcome): deleted or missing, so that a run may be repeated."""
    return _each(keys.select("key").distinct(), root, _delete)


def look_for_objects(keys: DataFrame, root: str) -> DataFrame:
    """(key, outcome) of keys (key): there or missing."""
    return _each(keys.select("key").distinct(), root, _look)


def junk_keys(junk: DataFrame, markdown: str = "markdown", catalog: str = "catalog", papers: str = "papers") -> DataFrame:
    """The keys that go with junk documents (stem): the markdown, the catalog row, and the source with either ending."""
    kinds = [("md", markdown), ("yaml", catalog), ("html", papers), ("htm", papers)]
    return junk.select(F.explode(F.array(*[sharded_key("stem", end, prefix) for end, prefix in kinds])).alias("key"))


def clean_junk(junk: DataFrame, root: str, **prefixes: str) -> DataFrame:
    """Delete what belongs to junk documents (stem) and say of each key whether it was there."""
    return delete_objects(junk_keys(junk, **prefixes), root)
