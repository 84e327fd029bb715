"""The facade over an animals-shaped graph, against walks listed one by one."""

import random
from collections import Counter

import pytest

from kgloom.extract import Extractor, Featurizer, IncrementalFeaturizer, update_experiment
from kgloom.functions import features, matrix
from kgloom.operators import expand, mutate
from kgloom.sources import seeds

SCHEMA = "s string, p string, o string, is_lit boolean"
ANIMALS = [
    *[(f"http://x/{a}", "http://x/type", f"http://x/{c}", False) for a, c in (("rex", "Dog"), ("tom", "Cat"), ("kit", "Cat"), ("ann", "Person"), ("bob", "Person"))],
    *[(f"http://x/{a}", "http://x/owns", f"http://x/{b}", False) for a, b in (("ann", "rex"), ("ann", "tom"), ("bob", "kit"))],
    *[(f"http://x/{a}", "http://x/legs", n, True) for a, n in (("rex", "4"), ("tom", "4"), ("kit", "3"), ("ann", "2"), ("bob", "2"))],
    ("http://x/Dog", "http://x/sub", "http://x/Animal", False),
    ("http://x/Cat", "http://x/sub", "http://x/Animal", False),
    ("http://x/ann", "http://x/name", "Ann B", True),
    ("http://x/bob", "http://x/name", "12", True),
    ("http://x/kit", "http://x/near", "bnode1", False),
    ("_:bnode1", "http://x/sub", "http://x/rex http://x/tom", False),
]
PREFIXES = [("http://x/", "x:"), ("x:owns", "has")]


def graph(spark):
    return spark.createDataFrame(ANIMALS, SCHEMA)


def walks(noi, depth, skip=(), rows=ANIMALS):
    """All walks, as a bag of (path, value), by the definition."""
    swap = lambda t: t.replace("http://x/", "x:").replace("x:owns", "has")
    out = Counter()

    def go(node, path, left):
        if not left:
            return
        edges = [(p, o, lit) for s, p, o, lit in rows if s == node] + [(p, s, False) for s, p, o, lit in rows if o == node and not lit]
        for p, o, lit in edges:
            for token in [o] if lit else o.split(" "):
                if swap(p) in skip or token in skip:
                    continue
                along = f"{path}.{swap(p)}" if path else swap(p)
                if token.startswith("bnode"):
                    go("_:" + token, along, left - 1)
                    continue
                out[along, swap(token)] += 1
                if not lit:
                    go(token, along, left - 1)

    go(noi, "", depth)
    return out


@pytest.mark.parametrize("depth", [0, 1, 2, 4])
def test_neighbourhoods_are_the_walks(spark, depth):
    nodes = [f"http://x/{n}" for n in ("rex", "kit", "ann", "Cat", "none")]
    given = seeds.from_list(spark, [*nodes[:3], *[f"<{n}>" for n in nodes[3:]]])
    skip = ["x:legs", "http://x/Dog"]
    got = {}
    for r in Extractor(graph(spark), PREFIXES).neighbourhoods(given, depth, skip).collect():
        got.setdefault(r.noi.strip("<>"), Counter())[r.path, r.value] += r.mult
    assert got == {n: w for n in nodes if (w := walks(n, depth, skip))}


def test_predicates_that_run_into_each_other(spark):
    rows = [("a", "p", "b", False), ("b", "q.r", "c", False), ("a", "p.q", "d", False), ("d", "r", "c", False)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert expand.ambiguous_labels(expand.edges(df)) and not expand.ambiguous_labels(expand.edges(graph(spark)))
    got = expand.expand(df, seeds.from_list(spark, ["a"]), 2, inverse=False)
    assert sorted((r.path, r.value, r.mult) for r in got.collect()) == [("p", "b", 1), ("p.q", "d", 1), ("p.q.r", "c", 2)]


def test_random_graphs(spark):
    rng = random.Random(6)
    for _ in range(3):
        rows = list({(f"http://x/n{rng.randrange(6)}", f"http://x/p{rng.randrange(3)}", f"http://x/n{rng.randrange(6)}", False) for _ in range(14)})
        rows += [(f"http://x/n{rng.randrange(6)}", "http://x/l", str(rng.randrange(3)), True) for _ in range(4)]
        rows = list(set(rows))
        nodes = seeds.from_list(spark, [f"http://x/n{k}" for k in range(6)])
        got = {}
        for r in Extractor(spark.createDataFrame(rows, SCHEMA), PREFIXES).neighbourhoods(nodes, 3).collect():
            got.setdefault(r.noi, Counter())[r.path, r.value] += r.mult
        assert got == {f"http://x/n{k}": w for k in range(6) if (w := walks(f"http://x/n{k}", 3, rows=rows))}


def test_dataset_and_matrix_at_depth_four(spark):
    extractor = Extractor(graph(spark), PREFIXES)
    nbh, labels = extractor.create_dataset(spark, 4, [("?s", "http://x/type", "http://x/Cat")], {"http://x/rex", "http://x/tom", "http://x/ann"})
    assert {r.noi: r.label for r in labels.collect()} == {"http://x/tom": 1, "http://x/kit": 1, "http://x/rex": 0, "http://x/ann": 0}
    model = Featurizer(counts=True, levels=True)
    cells, names = model.fit_transform(nbh)
    got = {(r.noi, r.feature): r.val for r in cells.collect()}
    want = {}
    bags = {n: walks(n, 4) for n in ("http://x/tom", "http://x/kit", "http://x/rex", "http://x/ann")}
    lists = {}
    for n, bag in bags.items():
        per, paths = {}, Counter()
        for (path, value), k in bag.items():
            per.setdefault(path, set()).add(value)
            paths[path] += k
            if k > 1:
                per[f"count.{path}.{value}"] = {str(k)}
        for path, k in paths.items():
            if k > 1:
                per[f"count.{path}"] = {str(k)}
        lists[n] = per
    every = {}
    for per in lists.values():
        for path, values in per.items():
            every.setdefault(path, set()).update(values)

    def number(v):
        try:
            return float(v)
        except ValueError:
            return None

    able = {p: v for p, v in every.items() if all(number(x) is not None for x in v)}
    for n, per in lists.items():
        for path, values in per.items():
            want[n, path] = 1.0
            for v in values:
                want[n, f"{path}§{v}"] = 1.0
            for level in able.get(path, ()):
                want[n, f"{path}<={level}"] = float(any(float(v) <= float(level) for v in values))
                want[n, f"{path}>={level}"] = float(any(float(v) >= float(level) for v in values))
    assert got == want
    assert [r.feature for r in names.orderBy("index").collect()] == sorted({f for _, f in want})


def test_transform_takes_the_training_levels(spark):
    rows = lambda *r: spark.createDataFrame([(n, "len", v, True, 1) for n, v in r], "noi string, path string, value string, is_lit boolean, mult long")
    model = Featurizer(levels=True)
    with pytest.raises(ValueError, match="fit first"):
        model.transform(rows(("a", "1")))
    model.fit_transform(rows(("a", "1"), ("b", "3")))
    cells, names = model.transform(rows(("c", "2"), ("d", "x")))
    assert {(r.noi, r.feature): r.val for r in cells.collect()} == {("c", "len"): 1, ("c", "len§2"): 1, ("c", "len<=1"): 0, ("c", "len>=1"): 1, ("c", "len<=3"): 1, ("c", "len>=3"): 0, ("d", "len"): 1, ("d", "len§x"): 1}
    assert names.count() == 7
    model.vocabulary = "train"
    assert {r.feature for r in model.transform(rows(("c", "2")))[0].collect()} == {"len", "len<=1", "len>=1", "len<=3", "len>=3"}


def test_real_values_take_the_place_of_names(spark):
    rows = [("a", "n", "1"), ("a", "n", "2.5"), ("b", "n", "x"), ("b", "n", "7"), ("a", "m", "y")]
    nbh = spark.createDataFrame([(*r, True, 1) for r in rows], "noi string, path string, value string, is_lit boolean, mult long")
    got = {(r.noi, r.feature): r.val for r in features.represent(nbh, real=True).collect()}
    assert got == {("a", "n"): 1, ("a", "n_real_data"): 2.5, ("b", "n"): 1, ("b", "n§x"): 1, ("b", "n§7"): 1, ("a", "m"): 1, ("a", "m§y"): 1}


def test_many_levels_are_dealt(spark, monkeypatch):
    nbh = spark.createDataFrame([(f"n{k % 9}", "len", str(k * 7 % 31), True, 1) for k in range(60)], "noi string, path string, value string, is_lit boolean, mult long")
    cells = lambda: sorted(tuple(r) for r in features.levels(nbh).collect())
    want = cells()
    monkeypatch.setattr(features, "BROADCAST_LEVELS", 3)
    assert cells() == want and want


def test_label_codes_refuse_what_they_have_not_seen(spark):
    codes = matrix.LabelCodes(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "label string"))
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "label string")
    assert sorted(((r.label, r.code) for r in codes.transform(rows).collect()), key=str) == [("a", 0), ("b", 1), (None, None)]
    with pytest.raises(Exception, match="unseen label: c"):
        codes.transform(spark.createDataFrame([("c",)], "label string")).collect()


def test_affected_tells_literals_from_nodes(spark):
    rows = [("a", "p", "b", True), ("b", "q", "c", False), ("d", "p", "b", True)]
    got = expand.affected(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("a",)], "node string"), 3)
    assert sorted((r.node, r.is_lit) for r in got.collect()) == [("a", False), ("b", True), ("d", False)]


def test_incremental_equals_full(spark):
    nodes = seeds.from_list(spark, ["http://x/rex", "http://x/tom", "http://x/kit", "http://x/ann"])
    current = IncrementalFeaturizer(Extractor(graph(spark), PREFIXES), nodes, 2)
    rows = lambda df: sorted((r.noi, r.path, r.value, r.mult) for r in df.collect())
    for adds, deletes in (([("http://x/kit", "http://x/owns", "http://x/ann", False)], None), (None, ["http://x/Cat"]), ([("http://x/tom", "http://x/legs", "5", True)], ["http://x/ann"])):
        got = current.apply(adds and spark.createDataFrame(adds, SCHEMA), deletes and spark.createDataFrame([(x,) for x in deletes], "node string"))
        assert rows(got) == rows(Extractor(current.extractor.triples, PREFIXES).neighbourhoods(nodes, 2))
    assert rows(current.apply()) == rows(current.nbh)


def test_update_experiment_ends_where_it_began(spark):
    nodes = seeds.from_list(spark, ["http://x/rex", "http://x/tom", "http://x/kit", "http://x/ann"])
    got = update_experiment(Extractor(graph(spark), PREFIXES), nodes, 2, 2, counts=True)
    assert (got["cosine"], got["cells"], got["columns"]) == (pytest.approx(1), 0, 0) and len(got["sampled"]) == 2
    assert {"full", "without", "incremental", "matrix"} == set(got["seconds"])


def test_entities_go_and_come(spark):
    left, gone = mutate.delete_entity(graph(spark), "http://x/ann")
    assert gone.count() == 5 and left.count() == len(ANIMALS) - 5
    assert mutate.add(left, gone).count() == len(ANIMALS)
    typed = spark.createDataFrame([("a", "p", "x", "Literal"), ("a", "p", "b", "URI")], "s string, p string, o string, object_type string")
    assert sorted((r.o, r.is_lit) for r in mutate.typed(typed).collect()) == [("b", False), ("x", True)]
    near = mutate.affected_nodes(graph(spark), "http://x/bob", seeds.from_list(spark, ["http://x/kit", "http://x/rex"]), 1)
    assert [r.noi for r in near.collect()] == ["http://x/kit"]
    assert expand.nested(Extractor(graph(spark)).neighbourhoods(seeds.from_list(spark, ["http://x/bob"]), 1)).first().paths["http://x/owns"] == ["http://x/kit"]
