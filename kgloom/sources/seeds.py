"""Nodes of interest: from patterns over a graph, from files, from lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def match(triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """The distinct bindings of the variables (?name) that fit all (s, p, o) patterns, as a SELECT over a graph pattern gives; variables that patterns share are joined on, in the patterns' order."""
    found = None
    for pattern in patterns:
        rows, names = triples, {}
        for column, term in zip(("s", "p", "o"), pattern, strict=True):
            if not term.startswith("?"):
                rows = rows.where(F.col(column) == term)
            elif term[1:] in names:
                rows = rows.where(F.col(column) == F.col(names[term[1:]]))
            else:
                names[term[1:]] = column
        rows = rows.select(*[F.col(c).alias(n) for n, c in names.items()]).distinct()
        if found is None:
            found = rows
        elif shared := [c for c in found.columns if c in names]:
            found = found.join(rows, shared)
        else:
            raise ValueError(f"{pattern} shares no variable with the patterns before it")
    if found is None:
        raise ValueError("no patterns")
    return found


def from_pattern(triples: DataFrame, patterns: list[tuple[str, str, str]], variable: str = "s") -> DataFrame:
    """(noi): a variable's bindings, as they are."""
    return match(triples, patterns).select(F.col(variable).alias("noi")).distinct()


def from_file(spark: SparkSession, path: str) -> DataFrame:
    """(noi): a node a line, in brackets; lines' ends are stripped of blanks."""
    return spark.read.text(path).select(F.concat(F.lit("<"), F.rtrim("value"), F.lit(">")).alias("noi")).distinct()


def from_list(spark: SparkSession, nodes: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in sorted(set(nodes))], "noi string")


def acquire(spark: SparkSession, triples: DataFrame, value) -> DataFrame:
    """(noi) from whatever names nodes: a list of patterns (variable ?s), a set of nodes, a frame of them, or a file's path."""
    if isinstance(value, DataFrame):
        return value.select("noi").distinct()
    if isinstance(value, set | frozenset):
        return from_list(spark, value)
    if isinstance(value, list):
        return from_pattern(triples, value)
    return from_file(spark, value)


def union(*seeds: DataFrame) -> DataFrame:
    """All nodes that any of the frames has, once."""
    out = seeds[0]
    for x in seeds[1:]:
        out = out.unionByName(x)
    return out.select("noi").distinct()


def sample(seeds: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """A simple random sample of k nodes that reruns give again."""
    return seeds.orderBy(F.xxhash64("noi", F.lit(seed)), "noi").limit(k)
