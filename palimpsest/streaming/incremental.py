"""Histories that grow: patches as a stream, folded batch by batch.

Each micro-batch continues from the checkpoint of the batch before it, whose number
the checkpoint has; a batch that is delivered again is folded from the
state before it, so that results are the same. Commits come in history order,
parents first; a batch takes whole commits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.blame import fold_history
from palimpsest.storage import discard, stash
from palimpsest.streaming.checkpoint import numbers, read_state, write_state


class IncrementalFold:
    """A ``foreachBatch`` function over patches (schema ``PATCHES``). ``edges``: the graph, or what
    gives it anew for each batch. Only the repositories of a batch are read and written."""

    def __init__(self, edges: DataFrame | Callable[[], DataFrame], folder: str, sink: Callable[[DataFrame, int], None], keep: int = 1000):
        self.edges, self.folder, self.sink, self.keep = edges, folder, sink, keep

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        touched = batch.select("repo").distinct()
        before = [n for n in numbers(spark, self.folder) if n < number]
        state = read_state(spark, self.folder, number=before[-1]).join(touched, "repo", "left_semi") if before else None
        edges = self.edges() if callable(self.edges) else self.edges
        found = stash(fold_history(batch, edges, state, self.keep), "fold")
        write_state(found.filter("live"), self.folder, touched.withColumn("version", F.lit(str(number))), number)
        self.sink(found.filter("NOT live").drop("live"), number)
        discard(found)


def start(patches: DataFrame, fold: IncrementalFold, checkpoint: str):
    """A streaming query that folds all that is there, batch by batch, and ends."""
    return patches.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
