"""A training-data pipeline over `documents`: quality classifier, line dedup, SimHash near-dedup, mixing, BPE.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a frame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm import bpe, line_dedup, mixing, quality, wide_simhash
from kgloom.llm.common import forget, release, tables, written


_BEFORE: set[str] = set()


def _staged(work):
    """A stage that begins by deleting the intermediate tables of the stage before, whose result has been written by then; tables that its own input reads stay."""

    @functools.wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(_BEFORE, docs)
        _BEFORE.clear()
        there = tables()
        found = work(spark, docs, sf_dir)
        _BEFORE.update(tables() - there)
        return found

    return stage


@_staged
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose best grade is unlikely go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where(F.col("tail_probability") >= quality.KEEP_AT).select(*docs.columns)


def _lines(text: Column) -> Column:
    """128-bit hashes of a text's distinct lines that aren't blank."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0)
    return F.array_distinct(F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))))


@_staged
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go. A document that only had such lines goes with them if each stands literally in a document that stays, and else stays whole: lines of one template may have different values."""
    cut = line_dedup.dedup(docs, constants=True, whole="__whole").withColumn("__row", F.monotonically_increasing_id())
    cut = written(cut, "line-cut")
    stays, bare = cut.where("__whole IS NULL"), cut.where("__whole IS NOT NULL")
    asked = written(bare.select("__row", F.explode(_lines(F.col("__whole"))).alias("line")), "line-asked")
    # Lines are folded before they meet, so one that many documents have is a row a task.
    found = stays.select(F.explode(_lines(F.col("text"))).alias("line")).distinct().join(asked.select("line").distinct(), "line", "left_semi")
    lost = asked.select("line").distinct().join(found, "line", "left_anti")
    back = bare.join(asked.join(lost, "line", "left_semi").select("__row").distinct(), "__row", "left_semi").withColumn("text", F.col("__whole"))
    return stays.unionByName(back).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_staged
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, a similarity of 0.8 or more."""
    return wide_simhash.keep_first(docs)


@_staged
def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for."""
    return mixing.mix(docs)


@_staged
def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    coded = bpe.encode(docs, bpe.default_tokenizer())
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("simhash", near_stage), ("mixing", mix_stage), ("bpe", bpe_stage)]

#: No SQL can express a trained classifier or BPE; tests/llm/test_pipeline.py holds each stage against brute force or its own operator's plan, and the run against its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        done = written(stage(spark, docs, sf_dir), name)
        forget(docs)
        docs = done
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
