"""Exact top-k search by inner product: aggregation of sorted lists without random access.

Every block of candidates keeps one list per axis, sorted by the component, built once. For a query the lists are read
from the end that scores highest for it, so many ranks at a time. What an unread entry may still add on an axis lies
between the list's worst and the rank reached, so each candidate has a lower and an upper bound; a query stops reading
when no outsider's upper bound reaches its k-th best lower bound, or what it knows to be reached elsewhere. Candidates
left get their whole score. The bounds of a portion of queries are worked out together, as matrix products.

The query set is stated (ids divisible by 100). It is written once; every block's task reads it past its lists, a portion
at a time. It goes in two passes: the first takes about the square root of the blocks, and the k-th best scores found
there are the scores to reach in the second, so that a block gives only what may rank. The blocks' results meet in a
ranking per query. The work is the number of queries times that of candidates; moved are the vectors once, the queries
once a block, and about 2 k sqrt(blocks) rows a query.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do rows with a null id;
of rows with equal ids each is a candidate, but for the query's own id; ties go to the smaller id, then repeated rows
rank one after the other; equal queries' rows (one id) rank as one query; shorter vectors count as filled up with zeros;
components are floor(scale * x) as longs; a component of 2**26 or more, of which sums might not fit a long, raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgloom.llm.common import documents, new_folder, written

_MOST = 1 << 26
_NONE = -(1 << 62)


def whole_numbers(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v) of the vectors that take part, components floored to longs."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("x").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    large = F.exists("x", lambda c: F.abs(c * F.lit(float(scale))) >= F.lit(float(_MOST)))
    whole = F.transform("x", lambda c: F.floor(c * F.lit(float(scale))))
    return rows.select("vec_id", F.when(large, F.raise_error(F.lit(f"a scaled component reaches {_MOST}"))).otherwise(whole).cast("array<bigint>").alias("v"))


class SortedLists:
    """A block of vectors with a sorted list per axis."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order].astype(np.int64)
        up = np.argsort(self.vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, up, axis=0)  # ascending
        self.rank = np.empty_like(up)
        np.put_along_axis(self.rank, up, np.arange(len(ids))[:, None], axis=0)
        self.most = float(np.abs(self.vectors).max(initial=1)) * max(vectors.shape[1], 1)

    def _bounds(self, queries: np.ndarray, read: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all (query, candidate) scores after `read` ranks of each list."""
        n, kind = len(self.ids), queries.dtype
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        low = plus @ self.values[0].astype(kind) + minus @ self.values[-1].astype(kind)
        low, high = np.repeat(low[:, None], n, axis=1), None
        for side, end, worst, reached in ((plus, self.rank >= n - read, self.values[0], self.values[-read]), (minus, self.rank < read, self.values[-1], self.values[read - 1])):
            low += side @ np.where(end, self.vectors - worst, 0).astype(kind).T
            gap = (side * (reached - worst).astype(kind)) @ (~end).astype(kind).T
            high = gap if high is None else high + gap
        return low, low + high

    def best(self, own: np.ndarray, queries: np.ndarray, k: int, reach: np.ndarray | None = None, step: int = 512) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its place, and ids and scores of its k best candidates but for its own id; those below `reach` are left out."""
        n = len(self.ids)
        # Bounds are exact in doubles below 2**52; larger products are worked out in whole numbers.
        exact = self.most * float(np.abs(queries).max(initial=1)) < 2**52
        queries = queries.astype(np.int64)
        reach = np.full(len(queries), _NONE, np.int64) if reach is None else reach
        todo, read = np.arange(len(queries)), min(step, n)
        while len(todo):
            low, high = self._bounds(queries[todo].astype(np.float64 if exact else np.int64), read)
            other = self.ids[None, :] != own[todo][:, None]
            low = np.where(other, low, _NONE)
            kth = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(todo), _NONE)
            stays = other & (high >= np.maximum(kth, reach[todo])[:, None])
            done = (stays.sum(axis=1) <= max(4 * k, n // 16)) | (read >= n)
            for at in np.flatnonzero(done):
                left, q = np.flatnonzero(stays[at]), int(todo[at])
                score = self.vectors[left] @ queries[q]
                left, score = left[score >= reach[q]], score[score >= reach[q]]
                top = np.lexsort((self.ids[left], -score))[:k]
                yield q, self.ids[left[top]], score[top]
            todo, read = todo[~done], min(2 * read, n)


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros, or cut where zeros meet them, to a width."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(whole.value_lengths())
    out = np.zeros((len(size), max(width, int(size.max(initial=0)))), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(whole.flatten())
    return out[:, :width]


def _portions(folder: str, portion: int) -> Iterator[pa.RecordBatch]:
    """The written queries, some at a time."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    for file in sorted(x.path for x in store.get_file_info(fs.FileSelector(path)) if x.path.endswith(".parquet")):
        with store.open_input_file(file) as source:
            yield from pq.ParquetFile(source).iter_batches(batch_size=portion)


def _pass(candidates: DataFrame, blocks: int, folder: str, k: int, portion: int) -> DataFrame:
    """(query_id, vec_id, score): what each block gives for the queries written in the folder."""

    def run(table: pa.Table) -> pa.Table:
        ids, column = table.column("vec_id").to_numpy(), table.column("v")
        out: list[list[np.ndarray]] = [[], [], []]
        lists, width = None, 0
        for batch in _portions(folder, portion):
            longest = int(np.asarray(batch.column("v").value_lengths()).max(initial=0))
            if lists is None or longest > width:
                width = max(longest, int(np.asarray(column.combine_chunks().value_lengths()).max(initial=0)))
                lists = SortedLists(ids, _matrix(column, width))
            own = batch.column("vec_id").to_numpy()
            for at, vec, score in lists.best(own, _matrix(batch.column("v"), width), k, batch.column("reach").to_numpy()):
                for values, x in zip(out, (np.full(len(vec), own[at]), vec, score), strict=True):
                    values.append(x)
        columns = [pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for x in out]
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    return candidates.repartition(blocks, "block").groupBy("block").applyInArrow(run, "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(candidates: DataFrame, queries: DataFrame, k: int = 10, block: int = 4096, portion: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates."""
    spark = candidates.sparkSession
    n = candidates.count()
    blocks = max(1, -(-n // block))
    place = F.xxhash64("vec_id", "v", F.monotonically_increasing_id())
    held = written(candidates.select("vec_id", "v", F.pmod(place, F.lit(blocks)).alias("block")), "blocks")
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    first = max(1, round(blocks**0.5))

    def ask(rows: DataFrame) -> str:
        folder = new_folder(spark, "queries")
        rows.select("vec_id", "v", "reach").write.parquet(folder)
        return folder

    none = ask(asked.withColumn("reach", F.lit(_NONE).cast("long")))
    known = written(_pass(held.where(F.col("block") < first), first, none, k, portion), "first-pass")
    if blocks == first:
        found = known
    else:
        kth = _ranked(known, k).where(F.col("rank") == k).select("query_id", "score")
        more = asked.join(kth, asked["vec_id"] == kth["query_id"], "left").withColumn("reach", F.coalesce("score", F.lit(_NONE).cast("long")))
        found = known.unionByName(_pass(held.where(F.col("block") >= first), blocks - first, ask(more), k, portion))
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(whole_numbers(documents(spark, sf_dir, "embeddings")), "vectors")
    return search(vectors, vectors.where("vec_id % 100 = 0"))


QUERIES = {"op6_topk": op6_topk}
SQL = {
    "op6_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
