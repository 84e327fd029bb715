"""A stream of changes to a graph, kept up with batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kgloom.extract import IncrementalFeaturizer

SCHEMA = "kind string, s string, p string, o string, is_lit boolean"


def apply_batch(current: IncrementalFeaturizer, batch: DataFrame) -> DataFrame:
    """The neighbourhoods after a batch of (kind, s, p, o, is_lit) rows: `delete` takes the entity s with all its triples, then `add` brings triples. An empty batch changes nothing; other kinds raise."""
    kinds = {r.kind for r in batch.select("kind").distinct().collect()}
    if kinds - {"add", "delete"}:
        raise ValueError(f"unknown kinds of change: {sorted(map(str, kinds - {'add', 'delete'}))}")
    gone = batch.where("kind = 'delete'").select(F.col("s").alias("node")).distinct() if "delete" in kinds else None
    new = batch.where("kind = 'add'").select("s", "p", "o", "is_lit").distinct() if "add" in kinds else None
    return current.apply(new, gone)


def follow(changes: DataFrame, current: IncrementalFeaturizer, checkpoint: str, done: Callable[[DataFrame, int], None] | None = None, once: bool = False) -> StreamingQuery:
    """Starts a query that takes each micro-batch of a stream of changes into the featurizer; `done` gets the neighbourhoods and the batch's number. With `once`, it ends when all that is there was read.

    A batch that is given again after a failure has the same effect: triples are a set and deletions are repeatable."""
    if current.nbh is None:
        current.build()

    def each(batch: DataFrame, number: int) -> None:
        found = apply_batch(current, batch.persist())
        batch.unpersist()
        if done:
            done(found, number)

    writer = changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
