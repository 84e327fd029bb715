import json

import pytest

from kgloom import changes
from kgloom.extract import Extractor, IncrementalFeaturizer
from kgloom.functions import centrality
from kgloom.sources import seeds

GRAPH = [("a", "p", "b", False), ("b", "p", "c", False), ("c", "q", "a", False), ("d", "p", "a", False), ("a", "n", "5", True)]
SCHEMA = "s string, p string, o string, is_lit boolean"


def rows(df):
    return sorted((r.noi, r.path, r.value, r.mult) for r in df.collect())


def test_stream_of_changes_equals_full_extraction(spark, tmp_path):
    current = IncrementalFeaturizer(Extractor(spark.createDataFrame(GRAPH, SCHEMA)), seeds.from_list(spark, "abd"), 2)
    batches = [[("add", "d", "q", "c", False), ("add", "d", "n", "7", True)], [("delete", "b", None, None, None), ("add", "a", "p", "e", False)]]
    (tmp_path / "in").mkdir()
    for k, batch in enumerate(batches):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("kind", "s", "p", "o", "is_lit"), x, strict=True))) for x in batch))
    seen = []
    stream = spark.readStream.schema(changes.SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    changes.follow(stream, current, str(tmp_path / "log"), lambda df, n: seen.append(rows(df)), once=True).awaitTermination()
    assert len(seen) == 2 and seen[0] != seen[1]
    want = {("a", "n", "5", True), ("c", "q", "a", False), ("d", "p", "a", False), ("d", "q", "c", False), ("d", "n", "7", True), ("a", "p", "e", False)}
    assert {tuple(r) for r in current.extractor.triples.collect()} == want
    assert seen[-1] == rows(Extractor(spark.createDataFrame(sorted(want), SCHEMA)).neighbourhoods(seeds.from_list(spark, "abd"), 2))
    with pytest.raises(ValueError, match="unknown kinds"):
        changes.apply_batch(current, spark.createDataFrame([("move", "a", "p", "b", False)], changes.SCHEMA))
    assert rows(changes.apply_batch(current, spark.createDataFrame([], changes.SCHEMA))) == seen[-1]


def test_centrality(spark):
    graph = spark.createDataFrame([*GRAPH, ("a", "r", "b", False)], SCHEMA)
    got = {r.node: (r.out_degree, r.in_degree, r.degree) for r in centrality.degrees(graph).collect()}
    assert got == {"a": (3, 2, 5), "b": (1, 2, 3), "c": (1, 1, 2), "d": (1, 0, 1)}
    links, nodes = {(s, o) for s, _, o, lit in [*GRAPH, ("e", "p", "f", False)] if not lit}, "abcdef"
    rank = dict.fromkeys(nodes, 1 / 6)
    for _ in range(7):
        out = {n: [o for s, o in links if s == n] for n in nodes}
        lost = sum(rank[n] for n in nodes if not out[n])
        rank = {n: 0.15 / 6 + 0.85 * (lost / 6 + sum(rank[s] / len(out[s]) for s in nodes if n in out[s])) for n in nodes}
    found = {r.node: r["rank"] for r in centrality.pagerank(spark.createDataFrame([*GRAPH, ("e", "p", "f", False)], SCHEMA), 7).collect()}
    assert found == pytest.approx(rank) and sum(found.values()) == pytest.approx(1)
    assert centrality.pagerank(graph.limit(0)).count() == 0
