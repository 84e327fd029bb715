"""Walks that aren't listed one by one: held against those that are, and over a hub whose pairs are too many to list."""

import random
from collections import Counter

import pytest

from kgloom.functions import features
from kgloom.operators import expand as graph
from kgloom.operators import mutate
from kgloom.plans import catalog

SCHEMA = "s string, p string, o string, is_lit boolean"
HUB = 100_000


def some_graph(seed):
    """A few hubs, edges that come twice or in both directions, literals that read like nodes, blank nodes, objects of two names."""
    draw = random.Random(seed)
    names = ["a", "b", "c", "d", "e", "h"]
    rows = [(draw.choice(names), draw.choice("pqr"), draw.choice([*names, "bnode1", "a b"]), False) for _ in range(14)]
    rows += [("_:bnode1", "q", "h", False), ("h", "q", "7", True), ("b", "p", "h", False), ("h", "p", "b", False)]
    return rows + [(draw.choice(names), draw.choice("pqr"), draw.choice(["5", "a", "bnode"]), True) for _ in range(6)] + rows[:2]


def listed(rows, nodes, depth, marked=False):
    """(noi, path, value, is_lit): how many walks, one after the other."""
    links = [(s, p, x, lit) for s, p, o, lit in rows for x in ([o] if lit else o.split(" "))]
    links += [(o, "^" + p if marked else p, x, False) for s, p, o, lit in rows if not lit for x in s.split(" ")]
    found, front = Counter(), Counter((n, "", n) for n in nodes)
    for _ in range(depth):
        ahead = Counter()
        for (noi, path, node), n in front.items():
            for s, p, x, lit in links:
                if s == node:
                    whole = f"{path}.{p}" if path else p
                    if lit or not x.startswith("bnode"):
                        found[noi, whole, x, lit] += n
                    if not lit:
                        ahead[noi, whole, "_:" + x if x.startswith("bnode") else x] += n
        front = ahead
    return found


def by_path(found):
    out = {}
    for (_, path, _, _), n in found.items():
        rows, walks = out.get(path, (0, 0))
        out[path] = rows + 1, walks + n
    return out


@pytest.mark.parametrize(("seed", "depth", "marked", "few"), [(1, 2, False, True), (2, 2, True, False), (3, 3, False, False), (4, 1, False, True)])
def test_sums_by_path_are_those_of_the_rows(spark, monkeypatch, seed, depth, marked, few):
    monkeypatch.setattr(graph, "FEW_NODES", 100 if few else 0)
    rows, nodes = some_graph(seed), ["a", "b", "c", "h", "gone"]
    walks = graph.walks(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(n,) for n in nodes], "noi string"), depth, marked=marked)
    want = listed(rows, nodes, depth, marked)
    assert {(r.noi, r.path, r.value, r.is_lit): r.mult for r in walks.rows().collect()} == want
    assert {r.path: (r.n_rows, r.n_walks) for r in walks.by_path().collect()} == by_path(want)


def test_labels_without_a_name_are_ambiguous(spark):
    rows = [("a", "p", "b", False), ("b", "", "c", False)]
    assert graph.ambiguous_labels(graph.edges(spark.createDataFrame(rows, SCHEMA)))


@pytest.fixture(scope="session")
def hub(spark, tmp_path_factory):
    """Tables of HUB customers in one nation, ten in another one, two suppliers and three orders of one customer: listing pairs of customers takes HUB * HUB rows."""
    folder = str(tmp_path_factory.mktemp("hub"))
    spark.range(HUB + 10).selectExpr("id AS c_custkey", f"CASE WHEN id < {HUB} THEN 3 ELSE 4 END AS c_nationkey", "'BUILDING' AS c_mktsegment").write.parquet(f"{folder}/customer.parquet")
    for name, schema, rows in (
        ("region", "r_regionkey int, r_name string", [(0, "ASIA")]),
        ("nation", "n_nationkey int, n_name string, n_regionkey int", [(3, "X", 0), (4, "Y", 0)]),
        ("supplier", "s_suppkey long, s_nationkey int", [(0, 3), (1, 4)]),
        ("orders", "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string", [(0, 7, "LOW", "F"), (1, 7, "LOW", "O"), (2, 7, "HIGH", "F")]),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


#: Rows and walks by path of the customers of the hub's tables.
ENDS = HUB * (HUB + 1) + 10 * 11
SUMS = {
    "inNation": (HUB + 10, HUB + 10),
    "inNation.inNation": (ENDS, ENDS),
    "inNation.inRegion": (HUB + 10, HUB + 10),
    "inNation.name": (HUB + 10, HUB + 10),
    "orderedBy": (3, 3),
    "orderedBy.orderedBy": (1, 3),
    "orderedBy.priority": (2, 3),
    "orderedBy.status": (2, 3),
}


def sums(df):
    return {r.path: (r.n_rows, r.n_walks) for r in df.collect()}


def test_depth2_over_a_hub(spark, hub):
    assert sums(catalog.queries()["g1_expand_depth2"](spark, hub)) == SUMS


def test_marked_walks_over_a_hub(spark, hub):
    names = {"inNation.inNation": "inNation.^inNation", "orderedBy": "^orderedBy", "orderedBy.orderedBy": "^orderedBy.orderedBy", "orderedBy.priority": "^orderedBy.priority", "orderedBy.status": "^orderedBy.status"}
    assert sums(catalog.queries()["g1_marked"](spark, hub)) == {names.get(path, path): n for path, n in SUMS.items()}


def test_walks_without_a_hub_that_went(spark, hub):
    """Nation 3 goes, and with it the neighbourhoods of all its customers but one's orders; the ten of nation 4 stay as they were."""
    stay = {"inNation": (10, 10), "inNation.inNation": (110, 110), "inNation.inRegion": (10, 10), "inNation.name": (10, 10)}
    assert sums(catalog.queries()["m5_incremental"](spark, hub)) == {path: stay.get(path, n) for path, n in SUMS.items()}


@pytest.mark.parametrize("seed", [5, 6])
def test_walks_after_a_change_are_those_of_the_new_graph(spark, seed):
    rows, nodes = some_graph(seed), ["a", "b", "c", "h"]
    left = [r for r in rows if "b" not in r[0].split(" ") and (r[3] or "b" not in r[2].split(" "))]
    frames = [spark.createDataFrame(x, SCHEMA) for x in (rows, left)]
    noi, gone = spark.createDataFrame([(n,) for n in nodes], "noi string"), spark.createDataFrame([(x,) for x in ("b", "a b")], "node string")
    got = mutate.refreshed_walks(frames[0], graph.walks(frames[0], noi, 2), noi, gone, frames[1], 2)
    want = listed(left, nodes, 2)
    assert {(r.noi, r.path, r.value, r.is_lit): r.mult for r in got.rows().collect()} == want
    assert {r.path: (r.n_rows, r.n_walks) for r in got.by_path().collect()} == by_path(want)


@pytest.mark.parametrize(("seed", "depth"), [(7, 1), (8, 2), (9, 2)])
def test_counts_of_walks_are_those_of_the_rows(spark, seed, depth):
    rows, nodes = some_graph(seed) + some_graph(seed)[:3], ["a", "b", "c", "h"]
    found = graph.walks(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(n,) for n in nodes], "noi string"), depth)
    want = Counter()
    for (noi, path, value, _), n in listed(rows, nodes, depth).items():
        want[noi, f"count.{path}.{value}"] += n
        want[noi, f"count.{path}"] += n
    assert Counter(map(tuple, features.walk_counts(found).collect())) == Counter((*key, str(n)) for key, n in want.items() if n > 1)


def test_counts_over_a_hub(spark, hub):
    got = catalog.queries()["a1_counts"](spark, hub)
    assert Counter((r.path, r.value, r["count"]) for r in got.groupBy("path", "value").count().collect()) == Counter([
        ("count.inNation.inNation", str(HUB + 1), HUB), ("count.inNation.inNation", "11", 10),
        ("count.orderedBy", "3", 1), ("count.orderedBy.orderedBy", "3", 1), ("count.orderedBy.orderedBy.customer/7", "3", 1), ("count.orderedBy.priority", "3", 1),
        ("count.orderedBy.priority.LOW", "2", 1), ("count.orderedBy.status", "3", 1), ("count.orderedBy.status.F", "2", 1),
    ])
