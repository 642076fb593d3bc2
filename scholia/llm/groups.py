"""Groups of rows in sorted Arrow batches, handed to numpy one after another."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _same(batch: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a row's keys differ from those of the row before; the first row counts as a difference."""
    new = np.zeros(batch.num_rows, bool)
    if batch.num_rows:
        new[0] = True
    for k in keys:
        col = batch.column(k).combine_chunks().to_numpy(zero_copy_only=False)
        new[1:] |= col[1:] != col[:-1]
    return new


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups: rows come sorted by the keys, and no group is cut between tables."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        starts = np.flatnonzero(_same(table, keys))
        if len(starts) < 2:
            rest = table
            continue
        yield table.slice(0, int(starts[-1])).combine_chunks()
        rest = table.slice(int(starts[-1]))
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Bring the rows of each key together and give fn one table of a whole group after another.

    The keys are integers.  Groups must be bounded; callers split larger ones into
    blocks first.  Python's cost follows the rows, not the number of groups, as far
    as fn's does.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, keys):
            at = np.flatnonzero(_same(table, keys)).tolist() + [table.num_rows]
            for a, b in zip(at, at[1:]):
                yield from fn(table.slice(a, b - a))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(task, schema)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n items its smallest fellow under the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if np.array_equal(before, label) and np.array_equal(label[a], label[b]):
            break
    return label
