"""Connected components of an edge list by alternating large-star and small-star rounds.

Nodes are longs; the label of a component is its smallest node. Every round's links and every round's least neighbours
are written to the shared folder, so no lineage grows. A node with over a two-thousandth of all links, as the root of a
large component becomes, has its least neighbour broadcast to them (`join_hot`), so its links never meet in one task;
counts and least neighbours are folded before they are shuffled. Nothing but a count and a checksum comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import forget, join_hot, written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


#: Rows of a table of links that make a task; a table of no more meets in one anyway.
_TASK = 250_000


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links to (node, component) for every node that has a link to another one. Null ends, loops and repeated links are ignored."""
    links = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = written(links, "links")
    before = _state(links)

    def kept(frame: DataFrame, kind: str) -> DataFrame:
        """Written by as many tasks as the links fill, however many partitions a shuffle has."""
        return written(frame.coalesce(max(1, -(-before[0] // _TASK))), kind)

    def to_least(rows: DataFrame, least: DataFrame) -> DataFrame:
        if before[0] <= _TASK:
            found = rows.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            found = join_hot(rows, least, ["u"], "n", "to").select(F.col("v").alias("u"), F.col("to.m").alias("v"))
        return found.where("u <> v")

    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        count = F.count("*").alias("n")
        least = kept(both.groupBy("u").agg(F.min("v").alias("m"), count).select("u", F.least("m", "u").alias("m"), "n"), "least")
        large = kept(to_least(both.where("v > u"), least).distinct(), "large-star")
        smallest = kept(large.groupBy("u").agg(F.min("v").alias("m"), count), "least")
        small = to_least(large, smallest)
        new = kept(small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct(), "links")
        after = _state(new)
        for old in (links, least, large, smallest):
            forget(old)
        links = new
        if after == before:
            break
        before = after
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
