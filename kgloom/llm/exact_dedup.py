"""Exact dedup over a cuckoo-filter index of text digests.

Every row's text is normalised (runs of white space become one space) and digested with SHA-256. A cuckoo filter holds
short tags of the live digests in buckets of four. The stored content is bucketed likewise: a digest and its value lie
under its tag and the pair of buckets that the tag may be in. A lookup asks the filter; on a tag hit it compares the full
digests of that one bucket of content, so the filter's false positives never merge two texts, and without a hit nothing
stored is read. A filter that overflows is rebuilt at twice the size from the stored digests.

Digests are indexed twice: first inside each input partition, which folds a hot text into one row per partition before
anything is shuffled (an index is given out and emptied when it holds `flush_at` digests), then by digest, over as many
parts as hold about `part_rows` folded rows each, so an index is bounded whatever the table's size. Texts with over a
two-thousandth of all rows are broadcast to the rows (at most 2,000 digests), so no text fills a task.

Digests stand for texts: two texts are taken as equal if their SHA-256 is.

Defined results: a null text counts as empty; empty texts form one group; one row of each group stays: that with the
smallest doc_id, nulls last, and the first of these as the table is read where ids repeat or all are null; an empty table
gives an empty result. `classes` ignores other columns of the input; `dedup` keeps them all, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import SPACE, documents, join_hot, text_or_empty, written

_SLOTS, _KICKS = 4, 200
_NO_ID = (1 << 63) - 1


class CuckooIndex:
    """Live digests with a value each: `tags` is the filter, `content` the buckets that its hits are verified against."""

    def __init__(self, buckets: int = 1024):
        self.resizes = self.size = self.compared = 0
        self._make(1 << max(4, (buckets - 1).bit_length()))

    def _make(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.tags: list[list[int]] = [[] for _ in range(buckets)]
        self.content: dict[tuple[int, int], list[list]] = {}

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & self.mask
        return tag, first, self._other(first, tag)

    def _other(self, at: int, tag: int) -> int:
        return (at ^ (tag * 0x5BD1E995)) & self.mask

    def _place(self, digest: bytes) -> bool:
        tag, at, other = self._places(digest)
        for k in (at, other):
            if len(self.tags[k]) < _SLOTS:
                self.tags[k].append(tag)
                return True
        for turn in range(_KICKS):
            row = self.tags[other]
            tag, row[turn % _SLOTS] = row[turn % _SLOTS], tag
            other = self._other(other, tag)
            if len(self.tags[other]) < _SLOTS:
                self.tags[other].append(tag)
                return True
        return False

    def _store(self, entry: list) -> None:
        tag, at, other = self._places(entry[0])
        self.content.setdefault((tag, min(at, other)), []).append(entry)

    def _grow(self) -> None:
        """Twice the buckets, from the stored digests; their entries move, they aren't copied."""
        entries, buckets = list(self.entries()), 2 * (self.mask + 1)
        while True:
            self._make(buckets)
            self.resizes += 1
            if all(self._place(x[0]) for x in entries):
                break
            buckets *= 2
        for x in entries:
            self._store(x)

    def entries(self) -> Iterator[list]:
        """Every live [digest, value]."""
        for bucket in self.content.values():
            yield from bucket

    def maybe(self, digest: bytes) -> bool:
        """The filter's answer alone: never false for a live digest."""
        tag, at, other = self._places(digest)
        return tag in self.tags[at] or tag in self.tags[other]

    def _entry(self, digest: bytes) -> list | None:
        tag, at, other = self._places(digest)
        if tag not in self.tags[at] and tag not in self.tags[other]:
            return None
        for entry in self.content.get((tag, min(at, other)), ()):
            self.compared += 1
            if entry[0] == digest:
                return entry
        return None

    def find(self, digest: bytes) -> list[int] | None:
        entry = self._entry(digest)
        return None if entry is None else entry[1]

    def insert(self, digest: bytes, value: list[int]) -> None:
        """A live digest gets the new value."""
        entry = self._entry(digest)
        if entry is not None:
            entry[1] = value
            return
        self.size += 1
        self._store([digest, value])
        if not self._place(digest):
            self._grow()

    def delete(self, digest: bytes) -> bool:
        """False if the digest isn't live."""
        entry = self._entry(digest)
        if entry is None:
            return False
        tag, at, other = self._places(digest)
        self.tags[at if tag in self.tags[at] else other].remove(tag)
        bucket = self.content[tag, min(at, other)]
        bucket[:] = [x for x in bucket if x is not entry]
        if not bucket:
            del self.content[tag, min(at, other)]
        self.size -= 1
        return True

    def __len__(self) -> int:
        return self.size


_KIND = "digest binary, keep_id long, keep_row long, group_size long"
_GROUP = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])


def _emit(index: CuckooIndex) -> pa.RecordBatch:
    found = list(index.entries())
    known = lambda k: pa.array([None if x[k] == _NO_ID else x[k] for _, x in found], pa.int64())
    columns = [pa.array([d for d, _ in found], pa.binary()), known(0), known(1), pa.array([x[2] for _, x in found], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, schema=_GROUP)


def _add(index: CuckooIndex, digest: bytes, doc: int | None, row: int, n: int) -> None:
    doc = _NO_ID if doc is None else doc
    held = index.find(digest)
    if held is None:
        index.insert(digest, [doc, row, n])
    else:
        held[0], held[1] = min((held[0], held[1]), (doc, row))
        held[2] += n


def _fold(flush_at: int | None):
    """Folds (digest, keep_id, keep_row, group_size) rows into one per digest; with flush_at, a digest may come again later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in _GROUP.names], strict=True):
                _add(index, *row)
            if flush_at and len(index) >= flush_at:
                yield _emit(index)
                index = CuckooIndex()
        yield _emit(index)

    return run


def digested(docs: DataFrame) -> DataFrame:
    """The input with `digest`, the SHA-256 of the normalised text."""
    return docs.withColumn("digest", F.unhex(F.sha2(F.encode(F.regexp_replace(text_or_empty(), SPACE, " "), "UTF-8"), 256)))


def groups(keys: DataFrame, flush_at: int = 500_000, part_rows: int = 200_000) -> DataFrame:
    """(doc_id, row, digest) rows to one row per digest: keep_id, keep_row, group_size."""
    rows = keys.select("digest", F.col("doc_id").cast("long").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
    partial = written(rows.mapInArrow(_fold(flush_at), _KIND), "digest-parts")
    parts = max(1, -(-partial.count() // part_rows))
    return partial.repartition(parts, "digest").mapInArrow(_fold(None), _KIND)


def _classes(rows: DataFrame) -> DataFrame:
    """(row, doc_id, text) rows, written, to (row, doc_id, keep_id, group_size, kept, text_sha256)."""
    keys = written(digested(rows).select("row", "doc_id", "digest"), "digests")
    known = written(groups(keys), "digest-groups")
    found = join_hot(keys, known, ["digest"], "group_size", "group")
    kept = F.col("row") == F.col("group.keep_row")
    return found.select("row", "doc_id", "group.keep_id", "group.group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def classes(docs: DataFrame) -> DataFrame:
    """Every input row's doc_id with keep_id, group_size, kept and text_sha256."""
    return _classes(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")).drop("row")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("whole")), "dedup-rows")
    stay = _classes(rows.select("row", "whole.doc_id", "whole.text")).where("kept").select("row")
    return rows.join(stay, "row", "left_semi").select("whole.*")


def apply_changes(live: DataFrame, inserted: DataFrame, deleted: DataFrame, part_rows: int = 200_000) -> DataFrame:
    """The (digest, keep_id, keep_row, group_size) rows of `groups` after `inserted` (doc_id, row, digest) rows came in and
    `deleted` (doc_id, digest) rows went, insertions first.

    A deletion makes its digest's group smaller by one; at 0 the digest leaves the index. A group that loses the row it
    kept has null keep_id and keep_row until a smaller or equal one is inserted, as the index doesn't hold its other rows.
    Deletions of digests that aren't live change nothing; those of null digests are ignored. Changes are folded by
    digest before they move, so each part's index holds about part_rows live digests."""
    kinds = ["digest", "keep_id", "keep_row", "group_size"]
    rows = live.select(*kinds, F.lit(0).alias("what")).unionByName(groups(inserted).select(*kinds, F.lit(1).alias("what")))
    rows = written(rows, "digest-live")
    ids = deleted.where("digest IS NOT NULL").select("digest", F.col("doc_id").cast("long").alias("keep_id"))
    none = F.lit(None).cast("long")
    gone = ids.groupBy("digest").agg(F.count("*").alias("group_size")).select("digest", none.alias("keep_id"), none.alias("keep_row"), "group_size", F.lit(2).alias("what"))
    # The deleted rows that may have been kept: at most two a digest, the live one's and the inserted ones'.
    lost = rows.where("keep_id IS NOT NULL").select("digest", "keep_id").distinct().join(ids, ["digest", "keep_id"], "left_semi")
    lost = lost.select("digest", "keep_id", none.alias("keep_row"), none.alias("group_size"), F.lit(3).alias("what"))
    rows = written(rows.unionByName(gone).unionByName(lost), "digest-changes")
    parts = max(1, -(-rows.count() // part_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for digest, doc, row, n, what in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if what < 2:
                    _add(index, digest, doc, _NO_ID if row is None else row, n)
                elif (held := index.find(digest)) is None:
                    continue
                elif what == 2:
                    held[2] -= n
                    if held[2] <= 0:
                        index.delete(digest)
                elif held[0] == doc:
                    held[0] = held[1] = _NO_ID
        yield _emit(index)

    return rows.repartition(parts, "digest").sortWithinPartitions("what").select(*kinds, "what").mapInArrow(run, _KIND)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir))


QUERIES = {"op5_exact_dedup": op5_exact_dedup}
SQL = {
    "op5_exact_dedup": r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)""",
}
