"""Weights of boosting rounds, votes, and summaries of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reweight(df: DataFrame, classes: int) -> DataFrame:
    """(.., alpha, weight): one round over (weight, loss, right) rows, right being 1 or -1. alpha is
    ln((1 + r) / (1 - r)) / 2 + ln(classes - 1) with r the sum of weight * right * loss; weights fall by e^(-alpha * right * loss) and are scaled to a sum of 1. alpha is null where r is not inside (-1, 1)."""
    part = F.col("weight") * F.col("right") * F.col("loss")
    r = F.col("__r")
    alpha = F.when(F.abs(r) < 1, F.log((1 + r) / (1 - r)) / 2 + F.log(F.lit(float(classes - 1))))
    rows = df.join(F.broadcast(df.agg(F.sum(part).alias("__r")))).withColumn("alpha", alpha)  # one row
    rows = rows.withColumn("weight", F.col("weight") * F.exp(-F.col("alpha") * F.col("right") * F.col("loss"))).drop("__r")
    return rows.join(F.broadcast(rows.agg(F.sum("weight").alias("__z")))).withColumn("weight", F.try_divide("weight", "__z")).drop("__z")


def vote(votes: DataFrame) -> DataFrame:
    """(item, predicted, score) of (item, class, alpha) rows: the class with the largest sum, ties to the smaller class; null where no sum is over 0."""
    sums = votes.groupBy("item", "class").agg(F.sum("alpha").alias("score"))
    best = sums.groupBy("item").agg(F.min_by("class", F.struct(-F.col("score"), F.col("class"))).alias("predicted"), F.max("score").alias("score"))
    return best.withColumn("predicted", F.when(F.col("score") > 0, F.col("predicted")))


def merged_folds(df: DataFrame) -> DataFrame:
    """(item, sign, difficult, predict, loss, detail, n): one row an item; means, and detail 0 only where zeros are the strict majority."""
    wrong, n = F.count(F.when(F.col("detail") == 0, 1)), F.count("*")
    means = [F.avg(c).alias(c) for c in ("sign", "difficult", "predict", "loss")]
    return df.groupBy("item").agg(*means, F.when(wrong * 2 > n, 0).otherwise(1).alias("detail"), n.alias("n"))


def fold_errors(df: DataFrame) -> DataFrame:
    """(fold, accuracy, mean_difficulty) of (fold, difficult, detail) rows: the mean difficulty of a fold's errors, 0 without any."""
    hard = F.avg(F.when(F.col("detail") == 0, F.col("difficult")))
    return df.groupBy("fold").agg(F.avg("detail").alias("accuracy"), F.coalesce(hard, F.lit(0.0)).alias("mean_difficulty"))


def confusion(df: DataFrame) -> DataFrame:
    """(tp, fp, tn, fn) of (label, predicted) rows of 0 and 1."""
    y, p = F.col("label") == 1, F.col("predicted") == 1
    return df.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in (("tp", y & p), ("fp", ~y & p), ("tn", ~y & ~p), ("fn", y & ~p))])
