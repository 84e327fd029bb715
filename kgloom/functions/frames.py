"""Small projections, reports and lookups around label, feature and result tables."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.operators.order import positions


def without_ends(column: Column) -> Column:
    """A name without its first and last character."""
    return F.when(F.length(column) >= 2, F.substring(column, F.lit(2), F.length(column) - 2)).otherwise("")


def formatted(node: Column, is_lit: Column) -> Column:
    """A node as \"literal\" or <name>."""
    return F.when(is_lit, F.concat(F.lit('"'), node, F.lit('"'))).otherwise(F.concat(F.lit("<"), node, F.lit(">")))


def renamed(df: DataFrame, names: dict[str, str], drop: Sequence[str] = ()) -> DataFrame:
    """Columns dropped, then renamed; those that aren't there are passed over."""
    return df.drop(*drop).withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def feature_columns(df: DataFrame, last: int = 4) -> list[str]:
    """All columns but the last ones (item, sign, difficult and id)."""
    return df.columns[: len(df.columns) - last] if last else list(df.columns)


def outcome(detail: Column) -> Column:
    """error to 0, correct to 1; anything else is null."""
    return F.when(detail == "error", 0).when(detail == "correct", 1)


def signed(label: Column) -> Column:
    """0 to -1, any other label to 1."""
    return F.when(label == 0, -1).otherwise(1)


def imputed(df: DataFrame, columns: Sequence[str] | None = None, value: float = 0.0) -> DataFrame:
    """Nulls and NaN of numeric columns replaced by a constant."""
    kinds = dict(df.dtypes)
    numeric = [c for c in columns or df.columns if kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[c].startswith("decimal")]
    real = [c for c in numeric if kinds[c] in ("double", "float")]
    return df.na.fill(value, numeric).withColumns({c: F.nanvl(c, F.lit(value)) for c in real})


def missing_values(df: DataFrame) -> DataFrame:
    """(column, missing) of the columns that have nulls."""
    counts = df.agg(*[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"c{k}") for k, c in enumerate(df.columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{k}").alias("missing")) for k, c in enumerate(df.columns)]))
    return counts.select(rows.alias("r")).select("r.*").where("missing > 0")


def duplicates(df: DataFrame, *by: str) -> DataFrame:
    """(by, n): combinations of values that several rows have."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")


def first_of_each(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key, in the rows' own order: de-duplication that keeps the order."""
    rank = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(rank)).where("__rank = 1").drop("__rank")


def classes(df: DataFrame, label: str) -> DataFrame:
    """(label, n): the distinct classes and their rows."""
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))


def sample_variance(df: DataFrame, column: str) -> DataFrame:
    """(variance) with n - 1 in the denominator; null for fewer than two values."""
    return df.agg(F.var_samp(column).alias("variance"))


def length_counts(rules: DataFrame, most: int) -> DataFrame:
    """(length, n) for every length from 0 to `most`: how many rules have so many items; rules is (rule, feature)."""
    sizes = rules.distinct().groupBy("rule").agg(F.count("*").alias("length"))
    every = rules.sparkSession.range(most + 1).select(F.col("id").alias("length"))
    return every.join(sizes.groupBy("length").agg(F.count("*").alias("k")), "length", "left").select("length", F.coalesce("k", F.lit(0)).cast("long").alias("n"))


def with_labels(features: DataFrame, labels: DataFrame, item: str = "item") -> DataFrame:
    """The rows of (noi, ...) features whose node the label table has, with its columns."""
    return features.join(labels.withColumnRenamed(item, "noi"), "noi")


def with_difficulty(data: DataFrame, difficulty: DataFrame, item: str = "item") -> DataFrame:
    """All rows, with the item's difficulty, null where it has none; a difficulty that the rows have already goes."""
    return data.drop("difficult").join(difficulty.select(item, "difficult"), item, "left")


def sorted_rows(df: DataFrame, *by: str) -> DataFrame:
    """The rows in order, numbered by `pos` from 1."""
    return positions(df, *by)


def holdout(df: DataFrame, column: str = "id", parts: int = 3, groups: int = 1) -> DataFrame:
    """The rows with `held`, true for one in `parts` by the number, and `part`, one of `groups` parts among those that stay."""
    number = F.col(column)
    return df.withColumn("held", number % parts == 0).withColumn("part", F.when(number % parts != 0, F.floor(number / parts) % groups).cast("long"))


def find_lt(values: Sequence[float], x: float) -> int:
    """The place of the last value below x in a sorted list; raises if there is none."""
    at = bisect_left(values, x)
    if not at:
        raise ValueError(f"no value below {x}")
    return at - 1


def find_interval(ends: Sequence[float], x: float) -> int:
    """The number of the interval (ends[k - 1], ends[k]] that x falls into, the first one without a lower end; raises beyond the last."""
    at = bisect_left(ends, x)
    if at == len(ends):
        raise ValueError(f"{x} is beyond the last interval")
    return at


def place_of(values: Sequence[float], x: float) -> int:
    """How many of the sorted values are at most x."""
    return bisect_right(values, x)
