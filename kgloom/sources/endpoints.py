"""Sources that answer queries: the contract, graphs in tables, and SPARQL endpoints over HTTP as a Spark data source."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A SELECT's result in the SPARQL JSON format.
RESULT = "struct<results: struct<bindings: array<map<string, struct<type: string, value: string, datatype: string, `xml:lang`: string>>>>>"


class TripleSource(Protocol):
    """Where triples come from: edges out of nodes, edges into them, and the whole graph."""

    def triples(self, spark: SparkSession) -> DataFrame: ...

    def forward(self, nodes: DataFrame) -> DataFrame: ...

    def inverse(self, nodes: DataFrame) -> DataFrame: ...


class GraphTable:
    """A graph in a frame of (s, p, o, is_lit)."""

    def __init__(self, frame: DataFrame):
        self.frame = frame

    def triples(self, spark: SparkSession) -> DataFrame:  # noqa: ARG002
        return self.frame

    def forward(self, nodes: DataFrame) -> DataFrame:
        """(noi, p, o, is_lit) of (noi) nodes; nodes without edges give nothing."""
        return nodes.select("noi", bare(F.col("noi")).alias("s")).join(self.frame, "s").select("noi", "p", "o", "is_lit")

    def inverse(self, nodes: DataFrame) -> DataFrame:
        """(noi, p, o, is_lit): predicates and subjects of the edges into the nodes."""
        into = self.frame.where("NOT is_lit").select(F.col("o").alias("__n"), "p", F.col("s").alias("o"), "is_lit")
        return nodes.select("noi", bare(F.col("noi")).alias("__n")).join(into, "__n").select("noi", "p", "o", "is_lit")


def bare(node: Column) -> Column:
    """A node's name without the brackets around it."""
    return F.regexp_replace(F.regexp_replace(node, "^<", ""), ">$", "")


def bindings(results: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows of SPARQL JSON results, one for each binding: for each name its value and, as name_kind, its kind; null where it is unbound. Text that isn't such a result gives no rows."""
    rows = results.select(F.explode(F.from_json(F.col(column), RESULT)["results"]["bindings"]).alias("b"))
    return rows.select(*[c for n in names for c in (F.col("b")[n]["value"].alias(n), F.col("b")[n]["type"].alias(f"{n}_kind"))])


class _Part(InputPartition):
    def __init__(self, queries: list[str]):
        self.queries = queries


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.wait = options["url"], float(options.get("wait", "0.1"))
        self.reasoning, self.skip = options.get("reasoning", "false"), options.get("failed", "raise") == "skip"
        self.queries = json.loads(options["queries"])
        self.width = int(options.get("queries_a_task", "100"))

    def partitions(self) -> list[_Part]:
        return [_Part(self.queries[k : k + self.width]) for k in range(0, len(self.queries), self.width)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for query in partition.queries:
            body = urllib.parse.urlencode({"query": query, "reasoning": self.reasoning}).encode()
            request = urllib.request.Request(self.url, body, {"Accept": "application/sparql-results+json"})
            try:
                with urllib.request.urlopen(request, timeout=60) as answer:  # noqa: S310  the user's own endpoint
                    yield query, answer.read().decode()
            except OSError:
                if not self.skip:
                    raise
            time.sleep(self.wait)


class SparqlSource(DataSource):
    """format("sparql"): (query, answer) rows. Options: url, queries (a JSON list), queries_a_task, reasoning, wait (seconds between queries), failed (raise or skip)."""

    @classmethod
    def name(cls) -> str:
        return "sparql"

    def schema(self) -> str:
        return "query string, answer string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return _Reader(self.options)


def ask(spark: SparkSession, url: str, queries: list[str], names: list[str], **options: str) -> DataFrame:
    """The bindings that an endpoint gives for these queries."""
    spark.dataSource.register(SparqlSource)
    answers = spark.read.format("sparql").options(url=url, queries=json.dumps(queries), **options).load()
    return bindings(answers, "answer", names)
