"""Miners against brute force and small exhaustive searches."""

import itertools
import math
import random

import numpy as np
import pytest

from kgloom.functions import frames
from kgloom.mining import agnostic, ruleset
from kgloom.operators import rules


def pairs_of(seed, n=60):
    r = random.Random(seed)
    return sorted({(r.choice("pqr"), f"n{r.randrange(7)}", f"n{r.randrange(7)}") for _ in range(n)})


def brute_itemsets(pairs, support, longest, complexity, size):
    of = {}
    for rel, a, b in pairs:
        of.setdefault(rel, set()).add((a, b))
    of = {r: s for r, s in of.items() if len(s) >= support}
    out = []
    ab = lambda r: f"?a {r} ?b"
    for r, s in of.items():
        out += [("single", ab(r), None, len(s)), ("single", f"?b {r} ?a", None, len(s))]
    if complexity >= 1:
        for x, y in itertools.combinations_with_replacement(sorted(of), 2):
            if size(x) + size(y) > longest:
                continue
            both, turned = of[x] & of[y], {p for p in of[x] if p[::-1] in of[y]}
            if x != y and len(both) >= support:
                out.append(("pair", ab(x), ab(y), len(both)))
            if len(turned) >= support:
                out.append(("inverse", ab(x), f"?b {y} ?a", len(turned)))
        for x, y in itertools.combinations(sorted(of), 2):
            for z in of:
                three = of[x] & of[y] & of[z]
                if z not in (x, y) and len(three) >= support and size(z) == 1 and size(x) + size(y) + size(z) <= longest:
                    out += [("triple", f"{ab(x)} & {ab(y)}", ab(z), len(three)), ("antecedent", f"{ab(x)} & {ab(y)}", None, len(of[x] & of[y]))]
    if complexity >= 2:
        for kind, key in (("chain_subject", 0), ("chain_object", 1)):
            for x, y in itertools.product(of, repeat=2):
                if size(x) + size(y) > longest - 1 or max(size(x), size(y)) >= longest - 1:
                    continue
                ends = {(p[1 - key], q[1 - key]) for p in of[x] for q in of[y] if p[key] == q[key]}
                left = f"?k {x} ?a & ?k {y} ?b" if key == 0 else f"?a {x} ?k & ?b {y} ?k"
                for z in of:
                    if size(z) < longest - 1 and len(ends & of[z]) >= support and len(ends) >= support:
                        out += [(kind, left, ab(z), len(ends & of[z])), ("antecedent", left, None, len(ends))]
    return sorted(set(out), key=str)


@pytest.mark.parametrize(("support", "longest", "complexity"), [(1, 5, 2), (6, 5, 2), (3, 3, 2), (2, 2, 2), (3, 5, 1), (3, 5, 0)])
def test_itemsets_against_brute_force(spark, support, longest, complexity):
    pairs = pairs_of(support)
    got = agnostic.itemsets(spark.createDataFrame(pairs, "rel string, a string, b string"), support, longest, complexity, agnostic.dots)
    assert sorted({tuple(r) for r in got.collect()}, key=str) == brute_itemsets(pairs, support, longest, complexity, lambda r: 1)


def test_lengths_of_paths(spark):
    df = spark.createDataFrame([("http://x/a.http://x/b",), ("a.b.c",)], "rel string")
    assert [tuple(r) for r in df.select(agnostic.colons(df.rel), agnostic.dots(df.rel)).collect()] == [(2, 2), (0, 3)]


def test_rules_have_both_splits(spark):
    pairs = [("p", "a", "b"), ("p", "a", "c"), ("p", "b", "c"), ("q", "a", "b"), ("q", "a", "c")]
    got = {(r.antecedent, r.consequent): r for r in agnostic.mine(spark.createDataFrame(pairs, "rel string, a string, b string"), 2, 5, 1, agnostic.dots).collect()}
    one, two = got["?a p ?b", "?a q ?b"], got["?a q ?b", "?a p ?b"]
    assert (one.support, one.confidence, one.lift, one.leverage, one.conviction) == (2, pytest.approx(2 / 3), pytest.approx(1 / 3), -4, pytest.approx(-3))
    assert (two.confidence, two.conviction) == (1, None)


def test_feature_names_are_parsed(spark):
    cells = spark.createDataFrame([("n", "p§v§w"), ("n", "p"), ("m", "p§v§w"), ("m", "q<=3"), ("m", "p§")], "noi string, feature string")
    assert sorted(tuple(r) for r in agnostic.feature_pairs(cells).collect()) == [("p", "m", ""), ("p", "m", "v§w"), ("p", "n", "v§w")]
    assert [tuple(r) for r in agnostic.relation_supports(cells).collect()] == [("p", 3)]


def test_hubs_are_cut_into_blocks(spark):
    pairs = [("p", "hub", f"x{k}") for k in range(40)] + [("q", "hub", f"y{k}") for k in range(30)] + [("q", "other", "y0"), ("p", "other", "x0")]
    df = spark.createDataFrame(pairs, "rel string, a string, b string")
    want = {("p", "p"): 1600, ("p", "q"): 1200, ("q", "p"): 1200, ("q", "q"): 900}
    for block in (2000, 7):
        got = rules.chain_ends(df, "subject", block).groupBy("rel1", "rel2").count().collect()
        assert {(r.rel1, r.rel2): r["count"] for r in got} == want
    # The hub is seen first; the other meeting point adds nothing new.
    assert {(r.rel1, r.rel2): r.antecedent for r in rules.approximate_ends(df).collect()} == want


def test_approximate_ends_are_a_lower_bound(spark):
    pairs = pairs_of(9, 40)
    df = spark.createDataFrame(pairs, "rel string, a string, b string")
    exact = {(r.rel1, r.rel2): r["count"] for r in rules.chain_ends(df, "object").groupBy("rel1", "rel2").count().collect()}
    of = {}
    for rel, a, b in pairs:
        of.setdefault((rel, b), set()).add(a)
    want = {}
    for x, y in itertools.product("pqr", repeat=2):
        keys = sorted((k for k in {k for _, k in of} if (x, k) in of and (y, k) in of), key=lambda k: (-len(of[x, k]) * len(of[y, k]), k))
        one, two, total = set(), set(), 0
        for k in keys:
            a, b = of[x, k], of[y, k]
            total += len(a) * len(b) - len(a & one) * len(b & two)
            one, two = one | a, two | b
        if keys:
            want[x, y] = total
    got = {(r.rel1, r.rel2): r.antecedent for r in rules.approximate_ends(df, "object").collect()}
    assert got == want and all(got[k] <= exact[k] for k in got)


TREES = """RandomForestClassificationModel: uid=x, numTrees=3
  Tree 0 (weight 1.0):
    If (feature 2 <= 0.5)
     If (feature 0 in {0.0})
      Predict: 0.0
     Else (feature 0 not in {0.0})
      Predict: 1.0
    Else (feature 2 > 0.5)
     Predict: 1.0
  Tree 1 (weight 1.0):
    Predict: 0.0
  Tree 2 (weight 1.0):
    If (feature 11 <= 1.5)
     Predict: 0.0
    Else (feature 11 > 1.5)
     Predict: 1.0
"""


def test_paths_of_trees():
    assert ruleset.paths_of_trees(TREES) == {frozenset({2, 0}), frozenset({2}), frozenset(), frozenset({11})}


def test_priors():
    p = ruleset.Priors(4, 2)
    assert p.spaces == [4, 6] and p.betas == [401, 601]
    lbb = lambda k, n, a, b: math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + math.lgamma(k + a) + math.lgamma(n - k + b) - math.lgamma(n + a + b)
    want = lbb(1, 4, 1, 401) + lbb(2, 6, 1, 601) + lbb(8, 10, 100, 1) + lbb(7, 9, 100, 1)
    assert p.score([1, 2, 2], 8, 2, 7, 2) == pytest.approx(want)
    bounds = p.bounds(10, 9)
    assert bounds["empty"] == pytest.approx(p.prior([])) and len(bounds["first_rule"]) == 2


def test_chains_find_the_best_set():
    r = np.random.default_rng(2)
    cover = r.random((60, 6)) < 0.3
    label = (cover[:, 1] | cover[:, 4]).astype(np.int8)
    kinds = ruleset.Kinds(cover, label, r.integers(1, 4, 60))
    found = [frozenset([f"f{k}"]) for k in range(5)] + [frozenset(["f1", "f2"])]
    cover[:, 5] = cover[:, 1] & cover[:, 2]
    priors = ruleset.Priors(6, 2)
    best = max(((ruleset.Chain(kinds, found, priors, 0.1, r).score(s), s) for n in range(1, 5) for s in itertools.combinations(range(6), n)), key=lambda x: x[0])
    runs = [ruleset.Chain(kinds, found, priors, 0.1, np.random.default_rng(k)).run(200) for k in range(4)]
    score, chosen = max(runs, key=lambda x: x[0])
    assert score == pytest.approx(best[0]) and sorted(chosen) == sorted(best[1]) == [1, 4]
    assert ruleset.Chain(kinds, found, priors, 0.1, np.random.default_rng(3)).run(50) == ruleset.Chain(kinds, found, priors, 0.1, np.random.default_rng(3)).run(50)
    one = ruleset.Kinds(cover[:, :1], cover[:, 0].astype(np.int8), np.ones(60, np.int64))
    assert ruleset.Chain(one, found[:1], priors, 0.1, r).run(5)[1] == [0]


def test_rule_set_miner(spark, capsys):
    r = random.Random(3)
    rows, labels = [], []
    for k in range(120):
        held = {f for f in ("a", "b", "c", "d") if r.random() < 0.5}
        rows += [(f"n{k}", f) for f in sorted(held)]
        labels.append((f"n{k}", int({"a", "b"} <= held or "d" in held)))
    features = spark.createDataFrame(rows, "noi string, feature string")
    frame = spark.createDataFrame(labels, "noi string, label long")
    miner = ruleset.RuleSetMiner(support=5, max_len_rule_set=2, max_iter=120, chains=6, forest_size=20, seed=4)
    accuracy, found = miner.fit(features, frame)
    assert accuracy == 1 and set(found) == {frozenset("d"), frozenset("ab")}
    assert sorted(miner.print_rules()) == ["a AND b", "d"] and "a AND b" in capsys.readouterr().out
    said = {r.noi: r.predicted for r in miner.predict(features, frame).collect()}
    assert said == dict(labels)
    none = ruleset.RuleSetMiner(support=101, max_len_rule_set=1, max_iter=3, chains=1, forest_size=3)
    assert none.fit(features, frame)[1] == []
    assert "?a" in ruleset.RuleSetMiner(support=1).fit(spark.createDataFrame([("n", "p§v"), ("n", "q§v")], "noi string, feature string")).first().antecedent


def test_rules_for_reading():
    assert ruleset.text_of(frozenset(["len<width", "a<=3", "b<4"]), ["width"]) == "a<=3 AND b<4 AND len<=width"
    sets = [frozenset("ab"), frozenset("a"), frozenset("cd"), frozenset("cd"), frozenset("abc")]
    assert rules.normalised(sets) == [frozenset("a"), frozenset("cd")]


def test_screening_by_criterion(spark):
    rows = [(1, 9, 1, 9, 1), (2, 5, 0, 10, 5), (3, 10, 10, 0, 0), (4, 0, 0, 10, 10)]
    names = "rule int, tp long, fp long, tn long, fn long"
    df = spark.createDataFrame(rows, names).selectExpr("*", "try_divide(tp, tp + fp) AS precision", "tn / (tn + fp) AS specificity", "tp / (tp + fn) AS sensitivity", "2 * tp / (2 * tp + fp + fn) AS f1")
    best = lambda c: [r.rule for r in rules.chosen(df, c, 2).collect()]
    assert best("precision") == [2, 1] and best("sensitivity") == [3, 1] and best("mcc") == [1, 2] and best("gain")[0] == 1 and best("specificity") == [2, 4]
    assert sorted(r.rule for r in rules.enough_positives(df, 60).collect()) == [1, 3]


def test_small_lookups(spark):
    assert [frames.find_lt([1, 3, 5], x) for x in (2, 3, 9)] == [0, 0, 2] and [frames.find_interval([1, 3, 5], x) for x in (0, 1, 2, 5)] == [0, 0, 1, 2]
    for f, x in ((frames.find_lt, 1), (frames.find_interval, 6)):
        with pytest.raises(ValueError):
            f([1, 3, 5], x)
    assert frames.place_of([1, 3, 5], 3) == 2
    df = spark.createDataFrame([(1, "a", 0.0, 0.0, 0, 1), (2, "a", 0.0, 0.0, 0, 1)], "f int, item string, sign double, difficult double, id int, g int")
    assert frames.feature_columns(df) == ["f", "item"] and frames.feature_columns(df, 0) == df.columns
