import math

from pyspark.sql import functions as F

from kgloom.functions import boosting, matrix
from kgloom.operators import expand, mutate, order, rules
from kgloom.plans import model_queries


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_positions_and_prefix_sums(spark):
    df = spark.createDataFrame([(k * 37 % 101, k % 3) for k in range(101)], "item long, w long")
    got = order.positions(df, "item", weight="w").orderBy("item").collect()
    upto = 0
    for k, r in enumerate(got):
        upto += r.w
        assert (r.item, r.pos, r.upto) == (k, k + 1, upto)
    assert order.positions(df.limit(0), "item", weight="w").count() == 0


def test_folds_keep_blocks_together(spark):
    df = spark.createDataFrame([(k, float(k // 7)) for k in range(43)], "item long, difficult double")
    got = order.shuffled_folds(df, "difficult", "item", 5).collect()
    assert sorted(r.id for r in got) == list(range(43))
    assert all(r.id // 10 == r.item // 10 and r.fold == r.id % 5 for r in got)


def test_bootstrap_is_inverse_lookup(spark):
    weights = [3, 0, 5, None, 1, 4]
    got = dict(rows(order.bootstrap(spark.createDataFrame(list(enumerate(weights)), "item long, w long"), "w", 9, "item"), "item", "copies"))
    total, want = 13, dict.fromkeys(range(6), 0)
    for j in range(1, 10):
        upto = 0
        for k, w in enumerate(weights):
            upto += w or 0
            if upto * 18 >= (2 * j - 1) * total:
                want[k] += 1
                break
    assert got == want
    zero = spark.createDataFrame([(1, 0), (2, None)], "item long, w long")
    assert rows(order.bootstrap(zero, "w", 5, "item"), "item", "copies") == [(1, 0), (2, 0)]


def test_reweight_and_vote(spark):
    df = spark.createDataFrame([(1, 0.5, 0.2, 1), (2, 0.5, 0.6, -1)], "item long, weight double, loss double, right long")
    r = 0.5 * 0.2 - 0.5 * 0.6
    alpha = math.log((1 + r) / (1 - r)) / 2 + math.log(2)
    new = [0.5 * math.exp(-alpha * 0.2), 0.5 * math.exp(alpha * 0.6)]
    for x, w in zip(boosting.reweight(df, 3).orderBy("item").collect(), new, strict=True):
        assert abs(x.alpha - alpha) < 1e-12 and abs(x.weight - w / sum(new)) < 1e-12
    votes = spark.createDataFrame([(1, "b", 1.0), (1, "a", 1.0), (2, "a", -1.0), (3, "a", 1.0), (3, "b", 0.6), (3, "b", 0.6)], "item long, class string, alpha double")
    assert [x[:2] for x in rows(boosting.vote(votes), "item", "predicted")] == [(1, "a"), (2, None), (3, "b")]


def test_merged_folds_ties_are_right(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 1, 0.1, 0), (1, 1, 0.5, 0, 0.3, 1), (2, 0, 0.1, 0, 0.0, 0)], "item long, sign long, difficult double, predict long, loss double, detail long")
    assert rows(boosting.merged_folds(df), "item", "predict", "detail", "n") == [(1, 0.5, 1, 2), (2, 0.0, 0, 1)]


def test_predict_treats_missing_columns(spark):
    features = spark.createDataFrame([("x", "f"), ("x", "g"), ("y", "f")], "noi string, feature string")
    nodes = spark.createDataFrame([("x",), ("y",), ("z",)], "noi string")
    say = lambda *given: [p for _, p in rows(rules.predict(features, spark.createDataFrame(given, "rule int, feature string"), nodes), "noi", "predicted")]
    assert say((1, "f"), (1, "g")) == [1, 0, 0]
    assert say((1, "f"), (1, "gone")) == [0, 0, 0]
    assert say((1, "f"), (1, "count.a<=3")) == [1, 1, 0]
    assert say((1, "count.a<=3")) == [1, 1, 1]


def test_log_gamma(spark):
    xs = [0.25, 1.0, 2.5, 100.0, 123456.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", rules.log_gamma(F.col("x")).alias("y")).collect()
    assert all(math.isclose(r.y, math.lgamma(r.x), rel_tol=1e-10, abs_tol=1e-10) for r in got)


def test_matrices(spark):
    one = spark.createDataFrame([("a", "f", 1), ("a", "g", 1), ("b", "f", 2)], "noi string, feature string, val long")
    two = spark.createDataFrame([("a", "f", 1), ("c", "h", 1)], "noi string, feature string, val long")
    got = {r.noi: r.cosine for r in matrix.cosines(one, two).collect()}
    assert abs(got["a"] - 1 / math.sqrt(2)) < 1e-12 and got["b"] == got["c"] == 0
    assert rows(matrix.changed_cells(one, two), "noi", "feature") == [("a", "g"), ("b", "f"), ("c", "h")]
    assert rows(matrix.changed_columns(one, two), "feature", "side") == [("g", "first"), ("h", "second")]
    assert rows(matrix.vocabulary(one.unionByName(two)), "feature", "index") == [("f", 0), ("g", 1), ("h", 2)]
    assert matrix.vocabulary(one.limit(0)).count() == 0


def test_refreshed_equals_full(spark):
    schema = "s string, p string, o string, is_lit boolean"
    old = spark.createDataFrame([("a", "p", "b", False), ("b", "p", "c", False), ("c", "q", "d", False), ("e", "p", "f", False)], schema)
    new = mutate.add(mutate.delete_entities(old, spark.createDataFrame([("c",)], "node string")), spark.createDataFrame([("c", "q", "e", False)], schema))
    nodes = spark.createDataFrame([(x,) for x in "abdef"], "noi string")
    changed = spark.createDataFrame([("c",)], "node string")
    got = mutate.refreshed(old, expand.expand(old, nodes, 2), nodes, changed, new, 2)
    names = ("noi", "path", "value", "mult")
    assert rows(got, *names) == rows(expand.expand(new, nodes, 2), *names)


def test_w6_draws_two_thirds_of_the_rows(spark, tmp_path):
    for n in (30, 2000):
        orders = [(k % n,) for k in range(3 * n)]
        spark.createDataFrame(orders, "o_custkey long").write.parquet(f"{tmp_path}/{n}/orders.parquet")
        got = model_queries.w6_bootstrap(spark, f"{tmp_path}/{n}").agg(F.sum("copies")).first()[0]
        assert got == n * 666 // 1000
