"""Where results go: feature tables, folds' results, matrices, graphs in the catalog, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = ("item", "sign", "difficult", "predict", "loss", "detail")


def one_csv(df: DataFrame, path: str) -> None:
    """A folder with one CSV file with a header: for results of a bounded size."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def wide(features: DataFrame, names: list[str] | None = None, val: str = "val") -> DataFrame:
    """(noi, feature, val) as a row a node and a column a feature, in the names' order, zeros elsewhere: for few features only, as each becomes a column."""
    names = sorted(r[0] for r in features.select("feature").distinct().collect()) if names is None else names
    value = F.col(val).cast("double")
    out = features.groupBy("noi").agg(F.map_from_entries(F.collect_list(F.struct("feature", value.alias("v")))).alias("__m"))
    return out.select("noi", *[F.coalesce(F.element_at("__m", F.lit(n)), F.lit(0.0)).alias(n) for n in names])


def save_features(features: DataFrame, labels: DataFrame, path: str, as_csv: bool = False) -> None:
    """Features of labelled nodes, partitioned by `part` (train, test): Parquet in long form, or a CSV a part with a column a feature, `index` first."""
    if not as_csv:
        features.join(labels, "noi").write.mode("overwrite").partitionBy("part").parquet(path)
        return
    names = sorted(r[0] for r in features.select("feature").distinct().collect())
    rows = labels.join(wide(features, names), "noi", "left").na.fill(0.0, names)
    for (part,) in labels.select("part").distinct().collect():
        own = rows.where(F.col("part") == part)
        one_csv(own.select(F.col("noi").alias("index"), *[F.col(f"`{n}`") for n in names], F.col("noi").alias("item"), "label"), f"{path}_{part}.csv")


def save_folds(results: DataFrame, path: str, errors_only: bool = False) -> None:
    """Folds' results as CSV, partitioned by fold; with errors_only the rows that were predicted wrong."""
    rows = results.where("detail = 0") if errors_only else results
    rows.select(*RESULT, "fold").write.mode("overwrite").partitionBy("fold").csv(path, header=True)


def save_merged(merged: DataFrame, path: str) -> None:
    """Merged folds as one CSV."""
    one_csv(merged.orderBy("item"), path)


def save_matrix(cells: DataFrame, names: DataFrame, path: str) -> None:
    """A sparse matrix: its cells and its column names, as Parquet beside each other."""
    cells.write.mode("overwrite").parquet(f"{path}/cells")
    names.write.mode("overwrite").parquet(f"{path}/columns")


def load_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/columns")


def upload_graph(triples: DataFrame, table: str) -> None:
    """The graph as a table of the catalog, replaced if it is there."""
    triples.write.mode("overwrite").saveAsTable(table)


def drop_graph(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def metric_table(rows: DataFrame) -> DataFrame:
    """(model, metric, value) rows as a row a model: accuracy, f1, precision, recall, seconds; null where a metric wasn't measured."""
    names = ("accuracy", "f1", "precision", "recall", "seconds")
    return rows.groupBy("model").agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])


def positive_relations(nbh: DataFrame, labels: DataFrame) -> DataFrame:
    """(path, n_nodes): paths around the nodes with label 1."""
    return nbh.join(labels.where("label = 1").select("noi"), "noi", "left_semi").groupBy("path").agg(F.count_distinct("noi").alias("n_nodes"))


def publish(triples: DataFrame, edges: DataFrame, nbh: DataFrame, features: DataFrame) -> None:
    """Views for Spark SQL: kg_triples, kg_edges, kg_neighborhood, kg_features."""
    for name, frame in (("kg_triples", triples), ("kg_edges", edges), ("kg_neighborhood", nbh), ("kg_features", features)):
        frame.createOrReplaceTempView(name)
