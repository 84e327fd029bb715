from pyspark.sql import functions as F

from kgloom.functions import credibility as cr
from kgloom.operators import mutate, rules

PAIRS = [("r", "a", "b"), ("r", "a", "b"), ("r", "a", "c"), ("s", "a", "b"), ("s", "b", "a"), ("t", "b", "c")]


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_supports_count_distinct_pairs(spark):
    pairs = spark.createDataFrame(PAIRS, "rel string, a string, b string")
    assert rows(rules.singles(pairs, 2), "rel", "support") == [("r", 2), ("s", 2)]
    assert rows(rules.conjunctions(pairs, 1), "rel1", "rel2", "support") == [("r", "s", 1)]
    assert rows(rules.inverses(pairs, 1), "rel1", "rel2", "support") == [("r", "s", 1), ("s", "s", 2)]
    assert rows(rules.singles(pairs.limit(0), 1), "rel") == []


def test_chains_against_brute_force(spark):
    pairs = spark.createDataFrame(PAIRS, "rel string, a string, b string")
    of = {rel: {(a, b) for r, a, b in PAIRS if r == rel} for rel in "rst"}
    for shared, end in (("subject", 1), ("object", 0)):
        want = []
        for x in "rst":
            for y in "rst":
                ends = {(p[end], q[end]) for p in of[x] for q in of[y] if p[1 - end] == q[1 - end]}
                want += [(x, y, z, len(ends), len(ends & of[z])) for z in "rst" if ends & of[z]]
        assert rows(rules.chains(pairs, 1, shared), "rel1", "rel2", "rel3", "antecedent", "support") == sorted(want)


def test_screen_keeps_rules_without_cover(spark):
    features = spark.createDataFrame([("x", "f"), ("x", "g"), ("y", "f")], "noi string, feature string")
    given = spark.createDataFrame([(1, "f"), (2, "f"), (2, "g"), (3, "none")], "rule int, feature string")
    labels = spark.createDataFrame([("x", 1), ("y", 0), ("z", 1)], "noi string, label int")
    assert rows(rules.screen(features, given, labels), "rule", "tp", "fp", "tn", "fn") == [(1, 1, 1, 0, 1), (2, 1, 0, 1, 1), (3, 0, 0, 1, 2)]


def test_delete_and_add_again(spark):
    triples = spark.createDataFrame([("a", "p", "b", False), ("b", "q", "a", True), ("c", "p", "a", False), ("a", "p", "a", False), ("d", "n", "b", False)], "s string, p string, o string, is_lit boolean")
    gone = mutate.delete_entities(triples, spark.createDataFrame([("a",)], "node string"))
    assert rows(gone, "s", "o") == [("b", "a"), ("d", "b")]
    back = mutate.entity_triples(triples, "a")
    assert back.count() == 4
    assert rows(mutate.add(gone, back), "s", "p", "o") == rows(triples, "s", "p", "o")


def test_credibility(spark):
    df = spark.createDataFrame([(0.0, 0), (0.1, 1), (0.15, 0), (1.0, 1)], "difficult double, detail long")
    assert rows(df.select(cr.bin_of(F.col("difficult"), 10).alias("b")), "b") == [(1,), (1,), (2,), (10,)]
    want = 1 - ((1 - 0.05) * 0.5 * 0.5 + (1 - 0.15) * 0.5 * 0.25)
    assert abs(cr.credibility(df).first().cr - want) < 1e-12
    assert cr.credibility(df.where("detail = 1")).first().cr == 1
