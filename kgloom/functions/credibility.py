"""Difficulty of nodes, loss weights and the credibility (Cr) of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scaled(df: DataFrame, column: str) -> DataFrame:
    """The column min-max scaled over all rows; 0 where all are equal."""
    ends = df.agg(F.min(column).alias("__low"), F.max(column).alias("__high"))
    value = F.coalesce(F.try_divide((F.col(column) - F.col("__low")).cast("double"), (F.col("__high") - F.col("__low")).cast("double")), F.lit(0.0))
    return df.join(F.broadcast(ends)).withColumn(column, value).drop("__low", "__high")


def weights(df: DataFrame, pre: float) -> DataFrame:
    """(.., loss, weight): the difficulty loss 1 / (1 + e^(pre * difficult)), min-max scaled, and its share of the sum."""
    out = scaled(df.withColumn("loss", 1 / (1 + F.exp(F.lit(pre) * F.col("difficult")))), "loss")
    return out.join(F.broadcast(out.agg(F.sum("loss").alias("__sum")))).withColumn("weight", F.try_divide("loss", "__sum")).drop("__sum")


def bin_of(value: Column, bins: int) -> Column:
    """The right-closed bin from 1; 0 falls into the first one, values outside [0, 1] into none."""
    bounds = F.array(*[F.lit(k / bins) for k in range(bins)])
    inner = F.when(value == 0, 1).otherwise(F.size(F.filter(bounds, lambda b: b < value)))
    return F.when((value >= 0) & (value <= 1), inner)


def credibility(df: DataFrame, bins: int = 10) -> DataFrame:
    """(cr) of (difficult, detail) rows, detail being 1 where the prediction is right: 1 less the bins' sum of (1 - mean difficulty) * share of errors * share of rows. 1 where there is no error."""
    parts = df.groupBy(bin_of(F.col("difficult"), bins).alias("bin")).agg(F.avg("difficult").alias("mean"), F.sum(1 - F.col("detail")).alias("err"), F.count("*").alias("n"))
    total = parts.agg(F.sum("err").alias("all_err"), F.sum("n").alias("all_n"))
    term = (1 - F.col("mean")) * F.try_divide(F.col("err"), F.col("all_err")) * F.col("n") / F.col("all_n")
    return parts.where("bin IS NOT NULL").join(F.broadcast(total)).agg((1 - F.coalesce(F.sum(term), F.lit(0.0))).alias("cr"))


def fold_summary(df: DataFrame) -> DataFrame:
    """(mean_accuracy, var_accuracy, errors) over the folds of (fold, detail) rows; the variance is the population's."""
    folds = df.groupBy("fold").agg(F.avg("detail").alias("acc"), F.sum(1 - F.col("detail")).alias("err"))
    return folds.agg(F.avg("acc").alias("mean_accuracy"), F.var_pop("acc").alias("var_accuracy"), F.sum("err").alias("errors"))


def credibility_by_value(df: DataFrame) -> DataFrame:
    """(cr) with a bin for each distinct difficulty: 1 less the sum of (1 - difficulty) * share of errors in the bin * share of rows. Rows without a difficulty are in no bin but count."""
    total = df.agg(F.count("*").alias("all_n"))
    parts = df.where("difficult IS NOT NULL").groupBy("difficult").agg((1 - F.avg("detail")).alias("err"), F.count("*").alias("n"))
    term = (1 - F.col("difficult")) * F.col("err") * F.col("n") / F.col("all_n")
    return parts.join(F.broadcast(total)).agg((1 - F.coalesce(F.sum(term), F.lit(0.0))).alias("cr"))  # one row


def running_errors(df: DataFrame) -> DataFrame:
    """(fold, errors, error_loss): totals over this and the folds before it, of errors, and of the mean loss of each fold's errors."""
    own = df.groupBy("fold").agg(F.sum(1 - F.col("detail")).alias("err"), F.coalesce(F.avg(F.when(F.col("detail") == 0, F.col("loss"))), F.lit(0.0)).alias("mean"))
    upto = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)  # a row a fold
    return own.select("fold", F.sum("err").over(upto).alias("errors"), F.sum("mean").over(upto).alias("error_loss"))
