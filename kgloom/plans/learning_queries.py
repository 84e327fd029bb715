"""Queries of the learners. Fitted models can't be said in SQL: what they give is checked by rows here and by tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom import learning
from kgloom.functions import credibility, features
from kgloom.operators import order
from kgloom.plans.graph_queries import _nbh


def _rows(spark: SparkSession, sf_dir: str, folds: int) -> DataFrame:
    """Customers of five nations, their nation to be told from its region and their orders' number."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_nationkey < 5")
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("difficult"))
    labels = c.join(n, "c_custkey", "left").select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("noi"), F.col("c_custkey").alias("item"), (F.col("c_nationkey") % 3).cast("int").alias("label"), F.coalesce("difficult", F.lit(0)).alias("difficult"))
    cells = features.represent(_nbh(spark, sf_dir, 1).where("path = 'inNation'"))
    rows, _ = learning.vectors(cells, credibility.scaled(labels, "difficult"))
    return learning.folded(rows, folds)


def b7_boosted_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folds of three boosting rounds."""
    found = learning.cross_validate(_rows(spark, sf_dir, 2), learning.boosted(3, 3, 1.0), 2)
    return found.groupBy("fold").agg(F.count("*").alias("n"), F.sum("detail").alias("n_right"))


def b8_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision tree and Gaussian Bayes over two folds."""
    rows, out = _rows(spark, sf_dir, 2), None
    for name in ("tree", "bayes"):
        own = learning.cross_validate(rows, learning.trainer(name, 3), 2).groupBy("fold").agg(F.sum("detail").alias("n_right")).withColumn("model", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def b1_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difficulty losses over all customers with orders."""
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("item")).agg(F.count("*").cast("double").alias("difficult"))
    return learning.difficulty_loss(n, 0.1).select("item", F.round("loss", 6).alias("loss"))


def w6_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random weighted bootstrap of int(0.666 n) rows."""
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("item")).agg(F.count("*").alias("n"))
    return order.random_bootstrap(n, "n", n.count() * 666 // 1000, 7, "item").where("copies > 0").select("item", "copies")


QUERIES = {f.__name__: f for f in (b7_boosted_folds, b8_baselines, b1_losses, w6_random)}
SQL = {
    "b1_losses": """WITH d AS (SELECT o_custkey AS item, count(*)::DOUBLE AS n FROM orders GROUP BY 1), x AS (SELECT item, 1 / (1 + exp(0.1 * n)) AS v FROM d)
 SELECT item, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 6) AS loss FROM x""",
}
