"""Counts, levels and binary features of a neighbourhood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.operators.expand import Walks, joined_path, of_nodes
from kgloom.shared import written


def number(value: Column) -> Column:
    """A value as a double where it is written as one, else null."""
    written = value.rlike(r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$")
    return F.when(written, value.try_cast("double"))


def counts(nbh: DataFrame) -> DataFrame:
    """(noi, path, value): count.path and count.path.value, where over 1. Paths are summed from the values' sums, so the neighbourhood is grouped once."""
    one = nbh.groupBy("noi", "path", "value").agg(F.sum("mult").alias("n"))
    all_ = one.groupBy("noi", "path").agg(F.sum("n").alias("n")).where("n > 1")
    name = F.concat_ws(".", F.lit("count"), "path", "value")
    return one.where("n > 1").select("noi", name.alias("path"), F.col("n").cast("string").alias("value")).unionByName(all_.select("noi", F.concat(F.lit("count."), F.col("path")).alias("path"), F.col("n").cast("string").alias("value")))


def walk_counts(walks: Walks) -> DataFrame:
    """The counts of all the walks' rows. Of a fan only what is counted over 1 is listed: ends of equal edges, ends of a front with several walks, and sums by path."""
    found = counts(walks.listed)
    for front, links in walks.fans:
        nodes = written(front.select("node").distinct(), "heads")
        one = written(of_nodes(links, nodes).groupBy("src", "p", "dst").agg(F.sum("m").alias("m")), "ends")
        sums = written(one.groupBy("src", "p").agg(F.sum("m").alias("m")), "sums")
        met = lambda part, ends: part.join(ends, F.col("node") == F.col("src")).select("noi", joined_path().alias("path"), *(["dst"] if "dst" in ends.columns else []), (F.col("mult") * F.col("m")).alias("n"))
        several = met(front.where("mult = 1"), written(one.where("m > 1"), "ends")).unionByName(met(front.where("mult > 1"), one))
        found = found.unionByName(several.select("noi", F.concat_ws(".", F.lit("count"), "path", "dst").alias("path"), F.col("n").cast("string").alias("value")))
        found = found.unionByName(met(front, sums).where("n > 1").select("noi", F.concat(F.lit("count."), F.col("path")).alias("path"), F.col("n").cast("string").alias("value")))
    return found


def with_counts(nbh: DataFrame) -> DataFrame:
    """The neighbourhood with its count features as further literal paths, each of multiplicity 1."""
    return nbh.unionByName(counts(nbh).select("noi", "path", "value", F.lit(True).alias("is_lit"), F.lit(1).cast("long").alias("mult")))


#: Levels up to this number are broadcast: rows of a path, a name and a number.
BROADCAST_LEVELS = 200_000


def level_steps(nbh: DataFrame) -> DataFrame:
    """(path, level, l): the distinct values of the paths whose every value is a number."""
    x = nbh.select("path", "value", number(F.col("value")).alias("x")).groupBy("path", "value").agg(F.first("x").alias("x"))
    able = x.groupBy("path").agg(F.count(F.when(F.col("x").isNull(), 1)).alias("bad")).where("bad = 0").select("path")
    return x.join(able, "path").select("path", F.col("value").alias("level"), F.col("x").alias("l"))


def levels(nbh: DataFrame, steps: DataFrame | None = None, salts: int = 64) -> DataFrame:
    """(noi, feature, val): path<=level and path>=level, for levels of these `steps` (default: this neighbourhood's own).

    Nodes with a value that isn't a number on a path, which only steps of other data allow, get no level of it. Steps are
    broadcast if there are at most BROADCAST_LEVELS; else a path's nodes are dealt over `salts` tasks."""
    steps = written(level_steps(nbh) if steps is None else steps, "levels")
    x = nbh.select("noi", "path", number(F.col("value")).alias("x")).join(F.broadcast(steps.select("path").distinct()) if (n := steps.count()) <= BROADCAST_LEVELS else steps.select("path").distinct(), "path", "left_semi")
    ends = x.groupBy("noi", "path").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.when(F.col("x").isNull(), 1)).alias("bad")).where("bad = 0")
    if n <= BROADCAST_LEVELS:
        both = ends.join(F.broadcast(steps), "path")
    else:
        dealt = steps.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        both = ends.withColumn("salt", F.pmod(F.xxhash64("noi"), F.lit(salts).cast("long"))).join(dealt, ["path", "salt"])
    sides = F.explode(F.array(F.struct(F.lit("<=").alias("sign"), (F.col("low") <= F.col("l")).alias("val")), F.struct(F.lit(">=").alias("sign"), (F.col("high") >= F.col("l")).alias("val"))))
    return both.select("noi", "path", "level", sides.alias("s")).select("noi", F.concat("path", "s.sign", "level").alias("feature"), "s.val")


def binary(nbh: DataFrame) -> DataFrame:
    """(noi, feature): presence of paths and of path§value pairs."""
    names = F.explode(F.array(F.col("path"), F.concat("path", F.lit("§"), "value")))
    return nbh.where("path <> ''").select("noi", names.alias("feature")).distinct()


def represent(nbh: DataFrame, real: bool = False, level_cells: DataFrame | None = None) -> DataFrame:
    """(noi, feature, val): the cells of the feature matrix. Presence of a path is 1; so is path§value, but with `real`,
    where all of a node's values of a path are numbers, path_real_data holds the largest of them instead. Levels go in as
    they are, those that don't hold as 0, so that their columns exist."""
    one = F.lit(1.0)
    shown = nbh.where("path <> ''").select("noi", F.col("path").alias("feature"), one.alias("val")).distinct()
    value = F.concat("path", F.lit("§"), "value")
    if real:
        x = nbh.where("path <> ''").select("noi", "path", "value", number(F.col("value")).alias("x")).distinct()
        able = x.groupBy("noi", "path").agg(F.max("x").alias("val"), F.count(F.when(F.col("x").isNull(), 1)).alias("bad"))
        numbers = able.where("bad = 0").select("noi", F.concat("path", F.lit("_real_data")).alias("feature"), "val")
        others = x.join(able.where("bad > 0").select("noi", "path"), ["noi", "path"], "left_semi")
        cells = shown.unionByName(numbers).unionByName(others.select("noi", value.alias("feature"), one.alias("val")))
    else:
        cells = binary(nbh).select("noi", "feature", one.alias("val"))
    if level_cells is not None:
        cells = cells.unionByName(level_cells.select("noi", "feature", F.col("val").cast("double").alias("val")))
    return cells
