"""From a graph and nodes of interest to a feature matrix: extraction, featurising, and keeping both up to date."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions import features, matrix
from kgloom.operators import expand, mutate
from kgloom.shared import written
from kgloom.sources import seeds
from kgloom.sources.endpoints import bare


@dataclass
class Extractor:
    """Neighbourhoods of nodes in a graph of (s, p, o, is_lit).

    `prefixes` are replaced, in order, in predicates and values; the skip list is held against replaced predicates and
    raw objects. With inverse=False only edges out of a node are followed; with marked=True inverse ones are called ^p."""

    triples: DataFrame
    prefixes: Sequence[tuple[str, str]] = ()
    inverse: bool = True
    marked: bool = False

    def neighbourhoods(self, nodes: DataFrame, depth: int, skip: Sequence[str] = ()) -> DataFrame:
        """(noi, path, value, is_lit, mult) of (noi) nodes, whose names may be in brackets."""
        graph = self.triples
        if self.prefixes:
            graph = graph.withColumn("p", matrix.rewritten(F.col("p"), self.prefixes))
        named = nodes.select("noi").distinct().select(F.col("noi").alias("__as"), bare(F.col("noi")).alias("noi"))
        found = expand.expand(graph, named.select("noi"), depth, list(skip), self.inverse, self.marked)
        if self.prefixes:
            found = found.withColumn("value", matrix.rewritten(F.col("value"), self.prefixes)).groupBy("noi", "path", "value", "is_lit").agg(F.sum("mult").alias("mult"))
        return found.join(named, "noi").select(F.col("__as").alias("noi"), "path", "value", "is_lit", "mult")

    def create_dataset(self, spark: SparkSession, depth: int, positive, negative=None, skip: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
        """(neighbourhoods, labels) of positive and negative nodes, each named by patterns, a set, a frame or a file: labels is (noi, label), 1 for those that are positive, also if they are negative too."""
        pos = seeds.acquire(spark, self.triples, positive)
        every = pos if negative is None else seeds.union(pos, seeds.acquire(spark, self.triples, negative))
        flags = pos.select("noi", F.lit(1).alias("__pos"))
        labels = every.distinct().join(flags, "noi", "left").select("noi", F.coalesce("__pos", F.lit(0)).cast("int").alias("label"))
        labels = written(labels, "labels")
        return written(self.neighbourhoods(labels, depth, skip), "neighbourhoods"), labels


@dataclass
class Featurizer:
    """Neighbourhoods to the cells of a matrix; remembers the training data's levels and vocabulary.

    transform: levels are those of the training data. vocabulary="data" takes the columns that the data has, "train" those
    of the training data, others go."""

    counts: bool = False
    levels: bool = False
    real: bool = False
    vocabulary: str = "data"
    steps: DataFrame | None = field(default=None, repr=False)
    names: DataFrame | None = field(default=None, repr=False)

    def _augmented(self, nbh: DataFrame) -> DataFrame:
        return written(features.with_counts(nbh), "counted") if self.counts else nbh

    def fit_transform(self, nbh: DataFrame) -> tuple[DataFrame, DataFrame]:
        """((noi, feature, val) cells, (feature, index) columns)."""
        whole = self._augmented(nbh)
        self.steps = written(features.level_steps(whole), "level-steps") if self.levels else None
        cells = written(features.represent(whole, self.real, features.levels(whole, self.steps) if self.levels else None), "cells")
        self.names = written(matrix.vocabulary(cells), "columns")
        return cells, self.names

    def transform(self, nbh: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The cells of other neighbourhoods, and their columns. Without a fit before, raises."""
        if self.names is None:
            raise ValueError("fit first")
        whole = self._augmented(nbh)
        cells = written(features.represent(whole, False, features.levels(whole, self.steps) if self.levels else None), "cells")
        if self.vocabulary == "train":
            return cells.join(self.names, "feature", "left_semi"), self.names
        return cells, written(matrix.vocabulary(cells), "columns")


@dataclass
class IncrementalFeaturizer:
    """A graph, its nodes' neighbourhoods, and changes to both: only nodes near a change are worked out again."""

    extractor: Extractor
    nodes: DataFrame
    depth: int
    skip: Sequence[str] = ()
    nbh: DataFrame | None = field(default=None, repr=False)

    def build(self) -> DataFrame:
        """All neighbourhoods from the graph as it is."""
        self.nbh = written(self.extractor.neighbourhoods(self.nodes, self.depth, self.skip), "neighbourhoods")
        return self.nbh

    def apply(self, adds: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
        """The neighbourhoods after (node) entities went with all their triples and (s, p, o, is_lit) triples came. Near a
        deletion is near in the graph before it, near an addition in the graph after it."""
        if self.nbh is None:
            self.build()
        old = new = self.extractor.triples
        touched = None
        if deletes is not None:
            new = mutate.delete_entities(new, deletes)
            touched = deletes.select("node")
        if adds is not None:
            new = mutate.add(new, adds.select(*new.columns))
            ends = adds.select(F.col("s").alias("node")).unionByName(adds.where("NOT is_lit").select(F.col("o").alias("node")))
            touched = ends if touched is None else touched.unionByName(ends)
        if touched is None:
            return self.nbh
        new = written(new, "graph")
        near = expand.affected(old, touched, self.depth).unionByName(expand.affected(new, touched, self.depth)).where("NOT is_lit").select("node").distinct()
        again = written(self.nodes.join(near, bare(F.col("noi")) == F.col("node"), "left_semi").select("noi"), "again")
        self.extractor.triples = new
        fresh = self.extractor.neighbourhoods(again, self.depth, self.skip)
        self.nbh = written(mutate.upsert(self.nbh, fresh, again), "neighbourhoods")
        return self.nbh

    def add_node(self, node: DataFrame, triples: DataFrame) -> DataFrame:
        """A new node of interest comes with its triples."""
        self.nodes = written(self.nodes.select("noi").unionByName(node.select("noi")).distinct(), "nodes")
        if self.nbh is None:
            self.build()
        before = self.nbh
        self.apply(adds=triples)
        fresh = self.extractor.neighbourhoods(node, self.depth, self.skip)
        self.nbh = written(mutate.upsert(self.nbh if self.nbh is not None else before, fresh, node), "neighbourhoods")
        return self.nbh


def update_experiment(extractor: Extractor, nodes: DataFrame, depth: int, k: int = 5, skip: Sequence[str] = (), seed: int = 0, counts: bool = False, levels: bool = False) -> dict:
    """k sampled nodes go from the graph and come back one by one, kept up to date; the result is held against the first
    extraction: the mean cosine of the matrices' rows, cells and columns that differ (none, if all is well), and seconds."""
    times: dict[str, float] = {}

    def timed(name: str, work):
        began = time.monotonic()
        out = work()
        times[name] = times.get(name, 0.0) + time.monotonic() - began
        return out

    spark = nodes.sparkSession
    whole = written(extractor.triples, "graph")
    first = timed("full", lambda: written(extractor.neighbourhoods(nodes, depth, skip), "neighbourhoods"))
    gone = [r.noi for r in seeds.sample(nodes, k, seed).collect()]
    name = lambda x: x.removeprefix("<").removesuffix(">")
    kept = {x: written(mutate.entity_triples(whole, name(x)).distinct(), "entity") for x in gone}
    entities = spark.createDataFrame([(name(x),) for x in gone], "node string")
    left = nodes.join(spark.createDataFrame([(x,) for x in gone], "noi string"), "noi", "left_anti")
    current = IncrementalFeaturizer(Extractor(written(mutate.delete_entities(whole, entities), "graph"), extractor.prefixes, extractor.inverse, extractor.marked), left, depth, skip)
    timed("without", current.build)
    for x in gone:
        node = spark.createDataFrame([(x,)], "noi string")
        timed("incremental", lambda node=node, x=x: current.add_node(node, kept[x]))
    featurizer = lambda: Featurizer(counts, levels)
    (one, _), (two, _) = timed("matrix", lambda: (featurizer().fit_transform(first), featurizer().fit_transform(current.nbh)))
    return {
        "cosine": matrix.mean_cosine(one, two).first().cosine,
        "cells": matrix.changed_cells(one, two).count(),
        "columns": matrix.changed_columns(one, two).count(),
        "sampled": gone,
        "seconds": times,
        "before": one,
        "after": two,
    }
