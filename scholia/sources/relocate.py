"""Files of a drop zone moved to their places, as a stream's sink that may stop and run again at any point.

For each file: put it at its target, tell of it, delete the source, in this order, so that
nothing is deleted before it is durable and told.  A target that is there already is the
fast path; it is what a run that stopped left, or a file dropped twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTCOMES = "source string, target string, outcome string"


def _store(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def _there(store, path: str) -> bool:
    from pyarrow import fs

    return store.get_file_info(path).type != fs.FileType.NotFound


def move(root: str, source: str, target: str, tell: Callable[[str], None], done: Callable[[str], None] = lambda step: None) -> str:
    """Move one file below `root`: relocated, already_at_target, partial_left_source or missing.

    The bytes are written beside the target and renamed, so a target is always whole.  `tell`
    says that the target is there; what it raises is no reason to keep the source, as a later
    sweep finds targets that no one was told of.  `done` is called behind each step.
    """
    store, base = _store(root)
    to, origin = f"{base}/{target}", f"{base}/{source}"
    outcome = "relocated"
    if _there(store, to):
        outcome = "already_at_target"
    elif not _there(store, origin):
        return "missing"
    else:
        folder, _, name = to.rpartition("/")
        store.create_dir(folder, recursive=True)
        beside = f"{folder}/.{name}.part"
        with store.open_input_stream(origin) as read, store.open_output_stream(beside) as write:
            while piece := read.read(1 << 20):
                write.write(piece)
        done("written")
        store.move(beside, to)
        done("put")
        try:
            tell(target)
        except OSError:
            pass
        done("told")
    try:
        if _there(store, origin):
            store.delete_file(origin)
    except OSError:
        return "partial_left_source" if outcome == "relocated" else outcome
    done("deleted")
    return outcome


def event_file(root: str, target: str) -> None:
    """Tell of a target by a file of its own below events/, named by the target, so that telling twice is telling once."""
    store, base = _store(root)
    store.create_dir(f"{base}/events", recursive=True)
    name = target.replace("/", "_")
    with store.open_output_stream(f"{base}/events/.{name}.part") as out:
        out.write(json.dumps({"subject": "ingested", "payload": json.dumps({"key": target, "source": "inbox"})}).encode())
    store.move(f"{base}/events/.{name}.part", f"{base}/events/{name}.json")


def relocated(moves: DataFrame, root: str) -> DataFrame:
    """(source, target, outcome) for rows (source, target), each moved by the task that holds it.

    Two sources of one target go to one task, so the second finds the target of the first.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            outcomes = [move(root, s, t, lambda x: event_file(root, x)) for s, t in zip(batch["source"], batch["target"])]
            yield pd.DataFrame({"source": batch["source"], "target": batch["target"], "outcome": outcomes})

    keyed = moves.select("source", "target").repartition("target").sortWithinPartitions("target", "source")
    return keyed.mapInPandas(task, OUTCOMES)


def relocate_sink(root: str, outcomes: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that moves a batch's files and then commits its outcomes as one folder below `outcomes`.

    A batch that comes again after a failure moves what is left to move; its record is
    written over as a whole, with already_at_target for what the first run had moved.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = relocated(batch, root).withColumn("batch", F.lit(number).cast("long"))
        rows.write.mode("overwrite").parquet(f"{outcomes.rstrip('/')}/batch={number}")

    return write
