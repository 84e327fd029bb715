"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A label's two ratings make a grade: 0 toxic, 1 of low quality, 2 good. One weight vector over hashed text features is
shared by all grades; ordered thresholds cut its score: P(grade >= k) = 1 / (1 + exp(cut_k - score)). The result of a
document is its expected grade and the tail probability of the best grade, by which it is selected.

Features are the presence of hashed words (letters only, lower case) and of word shapes (letter runs shortened) with the
share of the words they make up, in eighths. The model is fitted on a bounded sample of labelled rows (`max_rows`, those with the
smallest hash of their doc_id); every document is scored over its whole text.

Defined results: a null text counts as empty and is scored by the bias alone; labels with a null rating or without a
document are ignored; a document with several labels takes its lowest grade; without any labels, or with labels of one
grade only, every document gets the prior of that grade (the best one, if there are none); an empty table gives an
empty result; rows with equal doc_id are scored each; the input's other columns are kept by `score`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.llm.common import documents, eased, written

GRADES = 3
_BITS = 18
_UPPER, _LOWER = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[^\W\d_A]+")
_DIGITS, _LETTERS = re.compile(r"\d+"), re.compile(r"[^\W\d_]+")
_MEMO = 60_000
#: What a worker has worked out for words: the hashed word and the hashed shape.
_SEEN: dict[str, tuple[int, int]] = {}


def _word(word: str) -> tuple[int, int]:
    mask = (1 << _BITS) - 1
    plain = "".join(_LETTERS.findall(word)).lower()
    shape = _DIGITS.sub("0", _LOWER.sub("a", _UPPER.sub("A", word)))[:12]
    return (zlib.crc32(b"w" + plain.encode()) & mask, zlib.crc32(b"s" + shape.encode()) & mask)


def features(text: str | None) -> np.ndarray:
    """The distinct hashed features of a whole text."""
    if len(_SEEN) > _MEMO:
        _SEEN.clear()
    words = (text or "").split()
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    out, shapes, n = set(), {}, len(words)
    for w, k in counts.items():
        both = _SEEN.get(w)
        if both is None:
            both = _SEEN[w] = _word(w)
        out.add(both[0])
        shapes[both[1]] = shapes.get(both[1], 0) + k
    mask = (1 << _BITS) - 1
    for shape, k in shapes.items():
        out.add(shape)
        for step in range(1, -(-8 * k // n) + 1):  # the share in eighths, as nested features
            out.add((shape * 31 + step * 7919) & mask)
    return np.fromiter(out, np.int32, len(out))


@dataclass
class Ordinal:
    """score = weights[features].sum() + bias; cuts ascend."""

    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, found: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        score = float(self.weights[found].sum())
        return 1 / (1 + np.exp(np.clip(self.cuts - score, -60, 60)))


def fit(rows: list[np.ndarray], grades: np.ndarray, epochs: int = 30, rate: float = 0.1, decay: float = 1e-4, batch: int = 64, screen: float = 3.5) -> Ordinal:
    """Cumulative-link regression by minibatch AdaGrad; the order of rows is fixed, so refits agree.

    Only features whose documents' mean grade lies `screen` standard errors off the mean get a weight: rare words that
    mark nothing would else be learnt by heart."""
    weights, squares = np.zeros(1 << _BITS), np.full(1 << _BITS, 1e-3)
    seen = np.bincount(grades, minlength=GRADES)
    if (seen > 0).sum() < 2:
        best = int(seen.argmax()) if seen.sum() else GRADES - 1
        return Ordinal(weights.astype(np.float32), np.where(np.arange(1, GRADES) <= best, -8.0, 8.0))
    flat, each = np.concatenate(rows), np.repeat(grades, [len(x) for x in rows])
    shown, total = np.bincount(flat, minlength=1 << _BITS), np.bincount(flat, each, 1 << _BITS)
    off = np.abs(total / np.maximum(shown, 1) - grades.mean()) * np.sqrt(shown) / grades.std()
    telling = (off >= screen) & (shown >= 3)
    rows = [x[telling[x]] for x in rows]
    above = np.clip(1 - np.cumsum(seen)[:-1] / seen.sum(), 1e-3, 1 - 1e-3)
    cuts = np.maximum.accumulate(-np.log(above / (1 - above)) + np.arange(GRADES - 1) * 1e-3)
    cut_squares = np.full(GRADES - 1, 1e-2)
    # Rare grades weigh more, so that a few toxic documents aren't drowned.
    heavy = np.where(seen > 0, (seen.sum() / np.maximum(seen, 1) / GRADES) ** 0.5, 0)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        mixed = order.permutation(len(rows))
        for k in range(0, len(rows), batch):
            part = mixed[k : k + batch]
            flat = np.concatenate([rows[i] for i in part])
            own = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            score = np.bincount(own, weights[flat], len(part))
            tail = 1 / (1 + np.exp(np.clip(cuts - score[:, None], -40, 40)))
            # P(grade = y) is the difference of two neighbouring tails.
            full = np.concatenate([np.ones((len(part), 1)), tail, np.zeros((len(part), 1))], axis=1)
            slope = full * (1 - full)
            y, line = grades[part], np.arange(len(part))
            p = np.maximum(full[line, y] - full[line, y + 1], 1e-9)
            up = heavy[y] * (slope[line, y + 1] - slope[line, y]) / p  # of the loss, by the score
            at, inverse = np.unique(flat, return_inverse=True)
            grad = np.bincount(inverse, up[own], len(at)) / len(part) + decay * weights[at]
            squares[at] += grad**2
            weights[at] -= rate * grad / np.sqrt(squares[at])
            low, high = np.zeros(GRADES + 1), np.zeros(GRADES + 1)
            np.add.at(low, y, heavy[y] * slope[line, y] / p)
            np.add.at(high, y + 1, -heavy[y] * slope[line, y + 1] / p)
            push = (low + high)[1:GRADES] / len(part)
            cut_squares += push**2
            cuts = np.maximum.accumulate(cuts - rate * push / np.sqrt(cut_squares))
    return Ordinal(weights.astype(np.float32), cuts)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the labels."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    return known.select("doc_id", grade.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, max_values: int = 40_000_000, **how) -> Ordinal:
    """Fits on at most max_rows labelled rows, those with the smallest hash of their doc_id; only their features, not their
    texts, come to the driver, and of these at most max_values (160 MB): later rows are left out beyond. Of rows that
    share a doc_id the smallest text is taken, so refits agree. `how` goes to `fit`."""
    chosen = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # At most max_rows rows of two numbers.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in eased(batches):
            found = [features(x.as_py()).tobytes() for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array(found, pa.binary())], names=["doc_id", "grade", "found"])

    known = written(rows.select("doc_id", "text", "grade").mapInArrow(run, "doc_id long, grade int, found binary"), "quality-features")
    # A row a document of the sample: its running number of values, in the order of the hash.
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sizes = known.select("doc_id", (F.octet_length("found") / 4).cast("long").alias("n")).withColumn("upto", F.sum("n").over(order))
    last = sizes.where(F.col("upto") <= max_values).agg(F.max(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")).alias("last")).first().last
    if last is None:
        return fit([], np.zeros(0, np.int64), **how)
    got = known.where((F.xxhash64("doc_id") < last.h) | ((F.xxhash64("doc_id") == last.h) & (F.col("doc_id") <= last.doc_id))).collect()
    got.sort(key=lambda r: r.doc_id)
    return fit([np.frombuffer(r.found, np.int32) for r in got], np.array([r.grade for r in got], np.int64), **how)


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """The input with expected_grade and tail_probability (of the best grade)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**18 floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in eased(batches):
            tails = np.array([sent.value.tails(features(x.as_py())) for x in batch.column("text")]).reshape(-1, GRADES - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], names=[*batch.schema.names, "expected_grade", "tail_probability"])
        _SEEN.clear()

    docs = docs.drop("expected_grade", "tail_probability").withColumn("text", F.col("text").cast("string"))
    extra = [T.StructField(x, T.DoubleType()) for x in ("expected_grade", "tail_probability")]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *extra]))


#: A document is kept if the best grade is at least this likely: the largest tenth at which 98 % of the good documents of a
#: validation split stayed (README).
KEEP_AT = 0.3


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, documents(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= KEEP_AT).alias("keep"))


QUERIES = {"op10_quality": op10_quality}
SQL: dict[str, str] = {}
