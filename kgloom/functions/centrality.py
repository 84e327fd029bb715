"""Measures of nodes in a graph, to serve as difficulty: degrees and PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.shared import written


def degrees(triples: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, degree): edges out of a node, literals too, and edges into it."""
    out = triples.select(F.col("s").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    into = triples.where("NOT is_lit").select(F.col("o").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    found = out.unionByName(into).groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return found.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def pagerank(triples: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, rank), ranks summing to 1: each round a node gives its rank to those that its edges lead to, in equal parts; nodes without edges out give it to all. Repeated edges count once. A round is a shuffle of the edges' shares, summed before they move, and is written."""
    links = triples.where("NOT is_lit").select(F.col("s").alias("a"), F.col("o").alias("b")).distinct()
    sizes = links.groupBy("a").agg(F.count("*").alias("n"))
    links = written(links.join(sizes, "a"), "links")
    nodes = written(links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct().join(sizes, F.col("node") == F.col("a"), "left").select("node", F.col("n").isNull().alias("ends")), "nodes")
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    ranks = nodes.select("node", "ends", F.lit(1.0 / n).alias("rank"))
    for _ in range(rounds):
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("ends"), F.col("rank"))), F.lit(0.0))).first()[0]
        given = links.join(ranks.select(F.col("node").alias("a"), "rank"), "a").groupBy(F.col("b").alias("node")).agg(F.sum(F.col("rank") / F.col("n")).alias("got"))
        new = F.lit((1 - damping) / n + damping * lost / n) + F.lit(damping) * F.coalesce("got", F.lit(0.0))
        ranks = written(nodes.join(given, "node", "left").select("node", "ends", new.alias("rank")), "ranks")
    return ranks.select("node", "rank")
