"""Triples from ordinary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _triples(df: DataFrame, subject, predicate: str, obj, is_lit: bool) -> DataFrame:
    rows = df.select(subject.alias("s"), F.lit(predicate).alias("p"), obj.cast("string").alias("o"), F.lit(is_lit).alias("is_lit"))
    return rows.where(F.col("s").isNotNull() & F.col("o").isNotNull())


def _iri(kind: str, column: str):
    return F.concat(F.lit(kind + "/"), F.col(column).cast("string"))


def business_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, p, o, is_lit) of regions, nations, customers, suppliers and orders."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    region, nation, customer, supplier, orders = map(read, ("region", "nation", "customer", "supplier", "orders"))
    parts = [
        _triples(region, _iri("region", "r_regionkey"), "name", F.col("r_name"), True),
        _triples(nation, _iri("nation", "n_nationkey"), "inRegion", _iri("region", "n_regionkey"), False),
        _triples(nation, _iri("nation", "n_nationkey"), "name", F.col("n_name"), True),
        _triples(customer, _iri("customer", "c_custkey"), "inNation", _iri("nation", "c_nationkey"), False),
        _triples(customer, _iri("customer", "c_custkey"), "segment", F.col("c_mktsegment"), True),
        _triples(supplier, _iri("supplier", "s_suppkey"), "inNation", _iri("nation", "s_nationkey"), False),
        _triples(orders, _iri("order", "o_orderkey"), "orderedBy", _iri("customer", "o_custkey"), False),
        _triples(orders, _iri("order", "o_orderkey"), "priority", F.col("o_orderpriority"), True),
        _triples(orders, _iri("order", "o_orderkey"), "status", F.col("o_orderstatus"), True),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
