"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="kgloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean_up() -> None:
    for path, spark in list(_FOLDERS.items()):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001, S110  the JVM may have ended before us
            pass


atexit.register(_clean_up)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/kgloom-{kind}-{uuid.uuid4().hex}"
    _FOLDERS[path] = spark
    return path


def written(df: DataFrame, kind: str = "table") -> DataFrame:
    """The frame as a Parquet table of the shared folder: worked out once, its size known to the planner, and not lost with executors. It goes when the driver ends."""
    spark = df.sparkSession
    path = new_folder(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
