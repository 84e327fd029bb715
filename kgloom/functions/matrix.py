"""Named terms to indices, sparse matrices as (row, index, value) rows, and comparisons of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions.features import number
from kgloom.operators.order import positions


def rewritten(value: Column, prefixes: Sequence[tuple[str, str]]) -> Column:
    """Each replacement in turn, over the whole value: a later one sees what earlier ones wrote."""
    for old, new in prefixes:
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def real_features(nbh: DataFrame) -> DataFrame:
    """(noi, feature, val): path_real_data where a node's values of the path are all numbers; the largest of them."""
    x = nbh.select("noi", "path", number(F.col("value")).alias("x"))
    able = x.groupBy("noi", "path").agg(F.max("x").alias("val"), F.count(F.when(F.col("x").isNull(), 1)).alias("bad")).where("bad = 0")
    return able.select("noi", F.concat("path", F.lit("_real_data")).alias("feature"), "val")


def vocabulary(features: DataFrame, column: str = "feature") -> DataFrame:
    """(feature, index) of the distinct names, from 0 in binary order. Null is no name."""
    names = features.select(column).where(F.col(column).isNotNull()).distinct()
    return positions(names, column).select(column, (F.col("pos") - 1).alias("index"))


class LabelCodes:
    """Labels to numbers from 0, in the order of the sorted distinct labels of what they were fitted on."""

    def __init__(self, labels: DataFrame, column: str = "label"):
        self.column, self.codes = column, vocabulary(labels, column)

    def transform(self, df: DataFrame, code: str = "code") -> DataFrame:
        """The rows with their label's code; a label that wasn't there at fitting raises, a null one has none."""
        known = self.codes.select(F.col(self.column).alias("__label"), F.col("index").alias("__code"))
        found = df.join(known, F.col(self.column) == F.col("__label"), "left")
        unseen = F.col("__code").isNull() & F.col(self.column).isNotNull()
        value = F.when(unseen, F.raise_error(F.concat(F.lit("unseen label: "), F.col(self.column).cast("string"))).cast("long")).otherwise(F.col("__code"))
        return found.select(*[F.col(f"`{c}`") for c in df.columns], value.alias(code))


def sparse_rows(cells: DataFrame, names: DataFrame) -> DataFrame:
    """(noi, indices, values) of a matrix's rows: one row a node, sorted by index, zeros left out; features without an index go."""
    held = cells.join(names, "feature").where("val <> 0").groupBy("noi", "index").agg(F.max(F.col("val").cast("double")).alias("val"))
    rows = held.groupBy("noi").agg(F.sort_array(F.collect_list(F.struct("index", "val"))).alias("x"))
    return rows.select("noi", F.col("x.index").alias("indices"), F.col("x.val").alias("values"))


def mean_cosine(one: DataFrame, two: DataFrame) -> DataFrame:
    """(cosine): the mean over all nodes of the rows' cosines."""
    return cosines(one, two).agg(F.avg("cosine").alias("cosine"))


def coordinates(features: DataFrame, names: DataFrame) -> DataFrame:
    """(noi, index, val): the true cells of a binary matrix; features without an index go."""
    return features.join(names, "feature").select("noi", "index", F.lit(1).cast("long").alias("val")).distinct()


def _both(one: DataFrame, two: DataFrame) -> DataFrame:
    right = two.select("noi", "feature", F.col("val").alias("y"))
    return one.select("noi", "feature", F.col("val").alias("x")).join(right, ["noi", "feature"], "full")


def cosines(one: DataFrame, two: DataFrame) -> DataFrame:
    """(noi, cosine) of two matrices of (noi, feature, val) cells; 0 where either row is empty or zero."""
    dot, xx, yy = (F.coalesce(F.sum(c), F.lit(0)).cast("double") for c in (F.col("x") * F.col("y"), F.col("x") * F.col("x"), F.col("y") * F.col("y")))
    found = _both(one, two).groupBy("noi").agg(dot.alias("d"), xx.alias("a"), yy.alias("b"))
    return found.select("noi", F.coalesce(F.try_divide(F.col("d"), F.sqrt(F.col("a") * F.col("b"))), F.lit(0.0)).alias("cosine"))


def changed_cells(one: DataFrame, two: DataFrame) -> DataFrame:
    """(noi, feature, x, y): the cells that differ; an absent cell is null."""
    return _both(one, two).where(~F.col("x").eqNullSafe(F.col("y")))


def changed_columns(one: DataFrame, two: DataFrame) -> DataFrame:
    """(feature, side): names that only one of the matrices has."""
    a, b = (m.select("feature").distinct() for m in (one, two))
    return a.join(b, "feature", "left_anti").withColumn("side", F.lit("first")).unionByName(b.join(a, "feature", "left_anti").withColumn("side", F.lit("second")))
