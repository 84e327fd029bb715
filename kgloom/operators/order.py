"""Global positions, prefix sums, folds and weighted draws, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.shared import written


def settled(df: DataFrame) -> DataFrame:
    """The frame, worked out once, as a table of the shared folder."""
    return written(df, "settled")


def positions(df: DataFrame, *by: str, weight: str | None = None) -> DataFrame:
    """The rows with `pos`, from 1 in the order of the columns `by` (nulls first), which together should be unique, and with
    `upto`, the sum of an integer weight up to and with the row. Rows are cut into ranges; only a row a range is gathered."""
    rows = settled(df.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()))
    amount = F.coalesce(F.col(weight), F.lit(0)).cast("decimal(38,0)") if weight else F.lit(0).cast("decimal(38,0)")
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"), F.sum(amount).alias("__w"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    start = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("__n", "__w")]
    rows = rows.join(F.broadcast(sizes.select("__part", *start)), "__part")  # a row for each range
    inside = Window.partitionBy("__part").orderBy(*by)
    rows = rows.withColumn("pos", (F.row_number().over(inside) + F.col("__n0")).cast("long"))
    if weight:
        so_far = F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__w0")
        rows = rows.withColumn("upto", so_far.cast("long"))
    return rows.drop("__part", "__n0", "__w0")


def shuffled_folds(df: DataFrame, difficulty: str, item: str, folds: int, key: Column | None = None, block: int = 10) -> DataFrame:
    """The rows with `id` and `fold`: sorted by difficulty, permuted inside blocks of consecutive rows, dealt out in turn. The permutation is that of `key`, a hash of the item by default, so that reruns agree."""
    rows = positions(df, difficulty, item).withColumn("__block", F.floor((F.col("pos") - 1) / block))
    order = Window.partitionBy("__block").orderBy(F.xxhash64(item) if key is None else key, item)
    rows = rows.withColumn("id", (F.col("__block") * block + F.row_number().over(order) - 1).cast("long"))
    return rows.withColumn("fold", F.col("id") % folds).drop("__block", "pos")


def bootstrap(df: DataFrame, weight: str, draws: int, *by: str) -> DataFrame:
    """The rows with `copies`: how many of the equidistant draws u = (j - 1/2) / draws fall to the row, the first whose share of the summed integer weight reaches u. Rows without copies stay; all have 0 where the sum is 0."""
    rows = positions(df, *by, weight=weight)
    total = rows.agg(F.max("upto").alias("__total"))
    rows = rows.join(F.broadcast(total))  # one row
    reached = lambda x: F.expr(f"(2 * cast({x} as decimal(28,0)) * {int(draws)} + __total) div (2 * cast(__total as decimal(28,0)))")
    copies = F.when(F.col("__total") > 0, reached("upto") - reached(f"upto - coalesce({weight}, 0)")).otherwise(0)
    return rows.withColumn("copies", copies.cast("long")).drop("__total", "upto", "pos")


def random_draws(df: DataFrame, weight: str, draws: int, seed: int, *by: str) -> DataFrame:
    """(draw, pos): for each of `draws` random numbers the position of the row that it falls to, in proportion to an integer weight; with replacement.

    A draw is a whole number from 1 to the summed weight, from a hash of (seed, draw), so reruns agree. Draws meet rows by
    the cell of the cumulated weight that they fall into; a row with much weight is in many cells, but all rows together
    are in no more than there are cells and rows."""
    rows = settled(positions(df, *by, weight=weight).select("pos", "upto", F.coalesce(F.col(weight), F.lit(0)).cast("long").alias("own")).where("own > 0"))
    total, n = rows.agg(F.max("upto"), F.count("*")).first()
    spark = df.sparkSession
    if not total:
        return spark.createDataFrame([], "draw long, pos long")
    width = max(1, total // max(1, n))
    spot = F.pmod(F.xxhash64(F.lit(seed).cast("long"), F.col("id")), F.lit(total).cast("long")) + 1
    asked = spark.range(draws).select(F.col("id").alias("draw"), spot.alias("spot")).withColumn("cell", F.floor((F.col("spot") - 1) / width))
    low, high = F.floor((F.col("upto") - F.col("own")) / width), F.floor((F.col("upto") - 1) / width)
    held = rows.withColumn("cell", F.explode(F.sequence(low, high)))
    return asked.join(held, "cell").where("spot <= upto AND spot > upto - own").select("draw", "pos")


def random_bootstrap(df: DataFrame, weight: str, draws: int, seed: int, *by: str) -> DataFrame:
    """The rows with `copies`, how many random draws fell to them; see random_draws."""
    numbered = settled(positions(df, *by))
    times = random_draws(df, weight, draws, seed, *by).groupBy("pos").agg(F.count("*").alias("copies"))
    return numbered.join(times, "pos", "left").withColumn("copies", F.coalesce("copies", F.lit(0)).cast("long")).drop("pos")


def first_place(df: DataFrame, weight: str, shares: DataFrame, *by: str) -> DataFrame:
    """(share, pos) of (share) rows between 0 and 1: the first row whose cumulated share of the integer weight reaches it; an as-of lookup, as one sorted pass over both."""
    rows = positions(df, *by, weight=weight)
    total = rows.agg(F.max("upto").alias("__total"))
    marks = rows.where(F.coalesce(F.col(weight), F.lit(0)) > 0).join(F.broadcast(total)).select((F.col("upto") / F.col("__total")).alias("share"), "pos")  # one row
    # The next row's share at or above each asked one: the smallest, sought by range cells of a hundredth.
    cell = lambda x: F.least(F.floor(x * 100), F.lit(99)).cast("long")
    held = marks.withColumn("cell", cell(F.col("share")))
    firsts = held.groupBy("cell").agg(F.min(F.struct("share", "pos")).alias("first"))
    after = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)  # at most a hundred rows
    firsts = shares.sparkSession.range(100).withColumnRenamed("id", "cell").join(firsts, "cell", "left").withColumn("next", F.min("first").over(after))
    asked = shares.select("share").distinct().withColumn("cell", cell(F.col("share")))
    inside = asked.join(held.select("cell", F.col("share").alias("s"), "pos"), "cell").where("s >= share").groupBy("share").agg(F.min(F.struct("s", "pos")).alias("own"))
    found = asked.join(F.broadcast(firsts.select("cell", "next")), "cell").join(inside, "share", "left")
    return found.select("share", F.coalesce(F.col("own.pos"), F.col("next.pos")).alias("pos"))
