"""Every operator over clashing column names, nulls, repeated rows, a very long text and an empty table."""

import random

import pytest

from kgloom.llm import archives, bpe, exact_dedup, licenses, line_dedup, mixing, quality, simhash, suffix_dedup, topk, wide_simhash
from kgloom.llm.common import new_folder

# Names that the operators use for their own columns.
CLASHING = ("fp", "node", "component", "component_id", "key", "n", "size", "part", "data", "chunk", "copies", "ids", "keep_id", "kept", "text_sha256", "target", "n_lines", "n_dropped", "first", "dropped", "tail_probability")
SCHEMA = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHING)


def clashing(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(80)
    long = text(60_000)
    texts = [(0, base), (1, base), (1, base), (2, None), (3, ""), (4, long), (5, long), (None, base), (None, None), (6, "\x00 � é😀 " + text(30)), (7, " \t\n ")]
    return spark.createDataFrame([(d, t, None if d == 3 else "s", *["x"] * len(CLASHING)) for d, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(spark).cache()


def names(model):
    return sorted(str(r.doc_id) for r in model.select("doc_id").collect())


ALL = sorted(map(str, (0, 1, 1, 2, 3, 4, 5, None, None, 6, 7)))
RUNS = {
    "exact": lambda d: exact_dedup.classes(d),
    "line": lambda d: line_dedup.dedup(d),
    "suffix": lambda d: suffix_dedup.remove_repeats(d),
    "simhash": lambda d: simhash.near_groups(d),
    "wide": lambda d: wide_simhash.similar_groups(d),
    "bpe": lambda d: bpe.encode(d, bpe.default_tokenizer()),
}


@pytest.mark.parametrize("kind", RUNS)
def test_one_row_for_each_row(docs, kind):
    run = RUNS[kind]
    assert names(run(docs)) == ALL
    assert run(docs.limit(0)).count() == 0


def test_line_dedup_keeps_other_columns(docs):
    got = line_dedup.dedup(docs)
    assert set(docs.columns) <= set(got.columns) and len(set(got.columns)) == len(got.columns)


def test_keep_first_keeps_columns(docs):
    got = wide_simhash.keep_first(docs)
    assert got.columns == docs.columns
    assert names(got) == sorted(["0", "2", "4", "6"])  # blank texts are one group, and null ids follow their texts


def test_mixing_keeps_columns(docs):
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_quality_without_usable_labels(spark, docs):
    labels = spark.createDataFrame([(0, None, None), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.train(docs, labels)).count() == len(ALL)


def test_topk_of_nothing_and_of_ties(spark):
    schema = "vec_id long, embedding array<float>, query_id string, rank string, score string, v string"
    rows = [(k, [1.0, 0.0], "x", "x", "x", "x") for k in range(0, 30)]
    vectors = topk.whole_numbers(spark.createDataFrame(rows, schema))
    got = topk.search(vectors, vectors.where("vec_id % 100 = 0")).collect()
    assert sorted((r.rank, r.vec_id) for r in got) == [(k, k) for k in range(1, 11)]
    none = vectors.limit(0)
    assert topk.search(none, none).count() == 0


def test_archives_of_no_pages(spark):
    schema = "page_id long, url string, html string, digest string, record_type string"
    folder = new_folder(spark, "test")
    found = archives.written(archives.write_pages(spark.createDataFrame([], schema), folder))
    assert archives.read_back(spark, found, folder).count() == 0


def test_license_scan_of_long_text():
    mit = licenses.TEMPLATES["MIT"]
    found = licenses.Scanner().scan("filler words " * 50_000 + mit)
    assert [x[0] for x in found] == ["MIT"] and found[0][1] > 0.99
