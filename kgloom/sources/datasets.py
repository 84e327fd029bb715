"""Label, feature, difficulty and result tables of experiments on disk, and what is known of each dataset."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DatasetSpec:
    """Where a dataset lies, its columns, and the predicates that would give its labels away."""

    name: str
    graph: str
    label: str
    item: str
    kind: str = "nt"
    train: str = "trainingSet.tsv"
    test: str = "testSet.tsv"
    exclude: tuple[str, ...] = ()
    prefixes: tuple[tuple[str, str], ...] = field(default=())

    def skip(self, *more: str) -> list[str]:
        """Predicates and objects that expansion leaves out: those that give labels away, and others."""
        return [*self.exclude, *more]


class Registry:
    """Datasets by name; names are compared in lower case, without digits at the end and the `_tff` of a variant."""

    def __init__(self, *specs: DatasetSpec):
        self.specs: dict[str, DatasetSpec] = {}
        for spec in specs:
            self.add(spec)

    def add(self, spec: DatasetSpec) -> None:
        self.specs[plain_name(spec.name)] = spec

    def __getitem__(self, name: str) -> DatasetSpec:
        try:
            return self.specs[plain_name(name)]
        except KeyError:
            raise KeyError(f"unknown dataset {name}; known are {sorted(self.specs)}") from None

    def item(self, name: str) -> str:
        """The column that names a dataset's items."""
        return self[name].item

    def with_paths(self, folder: str) -> Registry:
        """The same datasets under a folder."""
        at = lambda x: f"{folder}/{x}"
        return Registry(*[replace(s, graph=at(s.graph), train=at(s.train), test=at(s.test)) for s in self.specs.values()])


def plain_name(name: str) -> str:
    return name.lower().removesuffix("_tff").rstrip("0123456789")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def missing_files(spark: SparkSession, *paths: str) -> list[str]:
    """Those of the paths that aren't there: a check before a long run."""
    return [x for x in paths if not exists(spark, x)]


def _required(spark: SparkSession, *paths: str) -> None:
    if gone := missing_files(spark, *paths):
        raise FileNotFoundError(f"missing: {gone}")


def label_table(spark: SparkSession, path: str, item: str, label: str, encoding: str = "UTF-8") -> DataFrame:
    """(item, label) of a TSV file with a header; rows without a label go."""
    _required(spark, path)
    rows = spark.read.csv(path, sep="\t", header=True, encoding=encoding)
    return rows.select(F.col(f"`{item}`").alias("item"), F.col(f"`{label}`").alias("label")).na.drop(subset=["label"])


def label_table_any(spark: SparkSession, path: str, item: str, label: str) -> DataFrame:
    """A label table in UTF-8 or, where it isn't valid as such, in ISO-8859-1."""
    broken = spark.read.csv(path, sep="\t", header=True).select(F.concat_ws("", "*").alias("x")).where(F.contains("x", F.lit("�"))).take(1)
    return label_table(spark, path, item, label, "ISO-8859-1" if broken else "UTF-8")


def train_and_test(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both sets' rows with `part`; rows that are in both come twice."""
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def feature_tables(spark: SparkSession, folder: str, name: str, variant: str = "") -> DataFrame:
    """The train and the test CSV of a dataset, one after the other; `variant` (as _TFF) stands before the file's part."""
    paths = [f"{folder}/{name}{variant}_{part}.csv" for part in ("train", "test")]
    _required(spark, *paths)
    train, test = (spark.read.csv(x, header=True, inferSchema=True) for x in paths)
    return train.unionByName(test, allowMissingColumns=True)


def difficulty_table(spark: SparkSession, path: str, item: str = "item", column: str = "difficult") -> DataFrame:
    """(item, difficult) of a CSV file with a header."""
    _required(spark, path)
    return spark.read.csv(path, header=True).select(F.col(f"`{item}`").alias("item"), F.col(f"`{column}`").try_cast("double").alias("difficult"))


def fold_results(spark: SparkSession, folder: str, pattern: str = r"Difficult_result_[^/]*_(\d+)\.csv") -> DataFrame:
    """(item, sign, difficult, predict, loss, detail, fold) of all folds' CSV files, the fold from the file's name; a byte-order mark before the header is left out."""
    names = ("item", "sign", "difficult", "predict", "loss", "detail")
    rows = spark.read.option("recursiveFileLookup", "true").csv(folder, header=True, pathGlobFilter="*.csv").withColumn("__file", F.col("_metadata.file_path"))
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    typed = [F.col("item"), F.col("sign").cast("long").alias("sign"), F.col("difficult").cast("double").alias("difficult"), F.col("predict").cast("long").alias("predict"), F.col("loss").cast("double").alias("loss"), F.col("detail").cast("long").alias("detail")]
    fold = F.regexp_extract("__file", pattern, 1).try_cast("int").alias("fold")
    return rows.where(F.col("__file").rlike(pattern)).select(*typed, fold).select(*names, "fold")
