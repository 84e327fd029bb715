"""Mixing sources to target weights by systematic sampling.

Sources share the mix by weight; no source may exceed `cap` times its own size, and what a capped source can't take is
shared again among the rest (water filling, solved in closed form over the sorted cap/weight ratios). Inside a source
each document expects target/size copies. Expected copies are prefix-summed in a fixed order, one random offset a
source is added, and a document is emitted once per integer boundary that its interval crosses. The order runs by size
class, so that the words taken come close to the target, then pseudo-randomly.

The prefix sum is two-level: a source is dealt into blocks (size class and leading hash digits, more of them for more rows); counts of blocks are
summed first, ranks are then taken inside blocks only. A source with a third of all rows so never meets in one task.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a source without words
gets target 0 and takes nothing; equal doc_ids are separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgloom.llm.common import WORD, documents, text_or_empty, written

#: Weights of the sources in code-point order, repeated.
WEIGHTS = (3.0, 1.0, 2.0)


def sized(docs: DataFrame) -> DataFrame:
    """The input with `size`, its number of words."""
    return docs.withColumn("size", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target). One row a source: a summary that fits one task."""
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    rows = sizes.withColumn("place", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("most") / F.col("weight"))
    # The sources of smaller ratio are full when one is: the level is what is left over the weights that are left.
    by_ratio = Window.orderBy("ratio", "place")
    all_rows = Window.partitionBy(F.lit(1))
    rows = rows.withColumn("full", F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.withColumn("total", F.sum("source_size").over(all_rows) * F.lit(share))
    rows = rows.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    rows = rows.withColumn("fits", F.when(F.col("level") <= F.col("ratio"), F.col("level")))
    rows = rows.withColumn("level", F.max("fits").over(all_rows))
    target = F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def _digest(column, seed: str = "") -> F.Column:
    text = F.coalesce(column.cast("string"), F.lit("null"))
    return F.md5(F.encode(F.concat(F.lit(seed), text) if seed else text, "UTF-8"))


def plan(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: str = "", block: int = 1_000_000) -> DataFrame:
    """Every row of (row columns, source, size) with source_size, target and `copies`, the times that the mix takes it.

    `docs` has doc_id, source and size; other columns are kept. Another seed orders the documents of a size class in
    another way and draws other offsets. The digits of the hash that rows are dealt by grow with the table, so that a
    block holds about `block` rows at most; they follow the order, so the result doesn't depend on them."""
    digits = max(1, math.ceil(math.log(max(docs.count(), 1) / block, 16)) + 1)
    docs = docs.withColumn("_hash", _digest(F.col("doc_id"), seed)).withColumn("_class", F.floor(F.sqrt(F.col("size").cast("double"))).cast("long"))
    docs = docs.withColumn("_deal", F.substring("_hash", 1, digits))
    blocks = docs.groupBy("source", "_class", "_deal").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    goals = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    before = Window.partitionBy("source").orderBy("_class", "_deal").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    blocks = blocks.alias("b").join(goals.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select("b.source", "_class", "_deal", "before", "source_size", "target")
    inside = Window.partitionBy("source", "_class", "_deal").orderBy("_hash", "doc_id")
    rows = docs.withColumn("_rank", F.row_number().over(inside))
    same = F.col("r.source").eqNullSafe(F.col("k.source")) & (F.col("r._class") == F.col("k._class")) & (F.col("r._deal") == F.col("k._deal"))
    found = rows.alias("r").join(blocks.alias("k"), same).select("r.*", "before", "source_size", "target")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(_digest(F.concat(F.lit("offset "), F.col("source")), seed), 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))
    place = F.col("before") + F.col("_rank")
    copies = F.floor(each * place + offset) - F.floor(each * (place - 1) + offset)
    return found.withColumn("copies", copies.cast("long")).drop("_hash", "_class", "_deal", "_rank", "before")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: str = "") -> DataFrame:
    """The mixed documents: each row of the input as often as the plan takes it."""
    keys = written(sized(docs).select("doc_id", "source", "size", F.xxhash64("text").alias("_text")), "sizes")
    taken = plan(keys, weights, share, cap, seed).where("copies > 0")
    # Rows that share a doc_id differ in text or are equal and interchangeable; they are numbered on both sides.
    nth = Window.partitionBy("doc_id", "_source", "_text").orderBy(F.lit(1))
    taken = taken.select("doc_id", F.col("source").alias("_source"), "_text", "copies")
    # The row travels as a struct, so that no column of it can clash with ours.
    left = docs.select(F.struct("*").alias("_row"), "doc_id", F.xxhash64("text").alias("_text"), F.col("source").alias("_source")).withColumn("_nth", F.row_number().over(nth))
    right = taken.withColumn("_nth", F.row_number().over(nth))
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & F.col("l._source").eqNullSafe(F.col("r._source")) & (F.col("l._text") == F.col("r._text")) & (F.col("l._nth") == F.col("r._nth"))
    rows = left.alias("l").join(right.alias("r"), same).select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select("_row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = written(sized(documents(spark, sf_dir)).select("doc_id", "source", "size"), "sizes")
    return plan(keys).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op9_mixing": op9_mixing}
SQL = {
    "op9_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(place % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most FROM s),
l AS (SELECT *, most / weight AS ratio,
       ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(most, coalesce((max(CASE WHEN level <= ratio THEN level END) OVER ()) * weight, most)) AS target FROM l),
r AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS each_,
       row_number() OVER (PARTITION BY d.source ORDER BY floor(sqrt(size::DOUBLE)), md5(doc_id::VARCHAR), doc_id) AS place,
       ('0x' || substr(md5(coalesce('offset ' || d.source, 'null')), 1, 5))::INT / 1048576.0::DOUBLE AS off
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target, (floor(each_ * place + off) - floor(each_ * (place - 1) + off))::BIGINT * size AS taken FROM r""",
}
