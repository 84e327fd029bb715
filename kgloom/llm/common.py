"""What the operators share: the cluster's shared folder, written intermediate tables, sizes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's white space, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_FOLDERS: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="kgloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean_up() -> None:
    for path, spark in list(_FOLDERS.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001, S110  the JVM may have ended before us
            pass


atexit.register(_clean_up)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/kgloom-{kind}-{uuid.uuid4().hex}"
    _FOLDERS[path] = spark
    return path


def written(df: DataFrame, kind: str = "table") -> DataFrame:
    """The frame, written as Parquet in the shared folder and read again: lineage ends there and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_folder(spark, kind)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.kgloom_path = path
    return found


def forget(table: DataFrame) -> None:
    """Deletes a table of `written` early: one that nothing is read from any more."""
    path = getattr(table, "kgloom_path", None)
    if path and _FOLDERS.pop(path, None):
        _delete(table.sparkSession, path)


def tables() -> set[str]:
    """The folders that are there."""
    return set(_FOLDERS)


def _roots(df: DataFrame) -> list[str]:
    """The folders and files that a frame reads."""
    leaves, found = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and "location" in dir(leaf.relation()):
            paths = leaf.relation().location().rootPaths()
            found += [paths.apply(i).toString() for i in range(paths.size())]
    return found


def release(paths: set[str], docs: DataFrame) -> None:
    """Deletes those of the folders that `docs` doesn't read."""
    plain = lambda x: x.removeprefix("file:").lstrip("/")
    used = [plain(x) for x in _roots(docs)]
    for path in sorted(paths):
        if not any(x.startswith(plain(path)) for x in used) and _FOLDERS.pop(path, None):
            _delete(docs.sparkSession, path)


#: monotonically_increasing_id has the partition's number above this bit.
_PART = 33


def beside(ids: DataFrame, kind: str) -> str:
    """(row) numbers from monotonically_increasing_id, written by partition, for `chosen` to read."""
    folder = new_folder(ids.sparkSession, kind)
    parts = ids.select("row", F.shiftright("row", _PART).alias("part"))
    parts.repartition("part").write.partitionBy("part").parquet(folder)
    return folder


def chosen(folder: str):
    """A function for workers: which of some row numbers `beside` has written. It reads the numbers of one partition at a time, so texts needn't be shuffled to meet them."""
    held: dict[int, np.ndarray] = {}

    def load(part: int) -> np.ndarray:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        files = store.get_file_info(fs.FileSelector(f"{path}/part={part}", allow_not_found=True))
        found = [np.empty(0, np.int64)]
        for file in files:
            if file.path.endswith(".parquet"):
                with store.open_input_file(file.path) as source:
                    found.append(pq.ParquetFile(source).read(columns=["row"]).column("row").to_numpy())
        return np.sort(np.concatenate(found))

    def among(rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), bool)
        for part in np.unique(rows >> _PART).tolist():
            if part not in held:
                held.clear()
                held[part] = load(part)
            own = np.flatnonzero(rows >> _PART == part)
            out[own] = np.isin(rows[own], held[part])
        return out

    return among


HOT_KEYS = 2000


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], weight: str, name: str) -> DataFrame:
    """The left rows with `name`, a struct of the other columns of the right row with equal keys (null: there is none).

    `right` has one row a key and in `weight` the number of left rows with it. Keys with over one in HOT_KEYS of these
    rows, which are at most HOT_KEYS keys whatever the size, are broadcast; only the others meet by a shuffle, so no key
    fills a task. Left rows that found a hot key are spread in that shuffle, where they match nothing. Keys aren't null."""
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    most = total // HOT_KEYS
    value = F.struct(*[c for c in right.columns if c not in keys])
    hot = right.where(F.col(weight) > most).select(*keys, value.alias("__hot"))
    cold = right.where(F.col(weight) <= most).select(*keys, F.lit(0).cast("long").alias("__salt"), value.alias("__cold"))
    salt = F.when(F.col("__hot").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(1024)) + 1)
    found = left.join(F.broadcast(hot), keys, "left").withColumn("__salt", salt.cast("long")).join(cold, [*keys, "__salt"], "left")
    return found.select(*left.columns, F.coalesce("__hot", "__cold").alias(name))


def eased(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """A worker's batches, some rows at a time; when they end, memory that isn't needed goes back, so that idle workers are small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
