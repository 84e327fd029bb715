"""Boosting, baselines and folds on fixtures whose answers are known, and the command line end to end."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from kgloom import __main__ as cli
from kgloom import learning
from kgloom.operators import order


def rows(spark, n=60, noise=0.0, seed=1):
    """Three classes, told apart by one feature each."""
    r = random.Random(seed)
    cells, labels = [], []
    for k in range(n):
        y = k % 3
        labels.append((f"n{k}", k, y, r.random()))
        shown = y if r.random() >= noise else (y + 1) % 3
        cells += [(f"n{k}", f"f{shown}"), (f"n{k}", f"x{r.randrange(4)}")]
    frame = spark.createDataFrame(labels, "noi string, item long, label int, difficult double")
    out, names = learning.vectors(spark.createDataFrame(cells, "noi string, feature string"), frame)
    assert names == [f"f{k}" for k in range(3)] + [f"x{k}" for k in range(4)]
    return learning.folded(out, 3)


def test_vectors_hold_the_cells(spark):
    cells = spark.createDataFrame([("a", "g", 2.5), ("a", "f", 1.0), ("b", "g", 0.0)], "noi string, feature string, val double")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "noi string")
    out, names = learning.vectors(cells, nodes)
    assert names == ["f", "g"] and {r.noi: r.features.toArray().tolist() for r in out.collect()} == {"a": [1, 2.5], "b": [0, 0], "c": [0, 0]}


def test_losses(spark):
    got = {r.difficult: r.loss for r in learning.difficulty_loss(spark.createDataFrame([(0.0,), (1.0,), (0.5,), (None,)], "difficult double"), 2.0).collect()}
    raw = lambda x: 1 / (1 + math.exp(2 * x))
    assert got[0.0] == got[None] == 1 and got[1.0] == 0 and got[0.5] == pytest.approx((raw(0.5) - raw(1)) / (raw(0) - raw(1)))
    assert learning.difficulty_loss(spark.createDataFrame([(1.0,), (1.0,)], "difficult double"), 1.0).first().loss == 0


def test_random_draws_follow_the_weights(spark):
    weights = [0, 5, 1, None, 50, 3, 1]
    df = spark.createDataFrame(list(enumerate(weights)), "item long, w long")
    draws = {r.draw: r.pos for r in order.random_draws(df, "w", 3000, 5, "item").collect()}
    assert len(draws) == 3000
    share = {k: sum(p == k + 1 for p in draws.values()) / 3000 for k in range(7)}
    assert share[0] == share[3] == 0 and all(abs(share[k] - w / 60) < 0.03 for k, w in enumerate(weights) if w)
    assert draws == {r.draw: r.pos for r in order.random_draws(df, "w", 3000, 5, "item").collect()}
    assert draws != {r.draw: r.pos for r in order.random_draws(df, "w", 3000, 6, "item").collect()}
    times = {r.item: r.copies for r in order.random_bootstrap(df, "w", 3000, 5, "item").collect()}
    assert sum(times.values()) == 3000 and times[4] == sum(p == 5 for p in draws.values())
    assert order.random_draws(df.limit(0), "w", 5, 1, "item").count() == 0


@pytest.mark.parametrize("semantics", ["clean", "reference"])
def test_boosting_learns_and_reruns_agree(spark, semantics):
    data = rows(spark).withColumn("fold", F.col("id") % 2)
    found = learning.cross_validate(data, learning.boosted(3, 2, 1.0, 5, semantics), 2).collect()
    assert len(found) == 60 and sum(r.detail for r in found) >= 54
    data = learning.difficulty_loss(data, 1.0)
    one, two = (learning.Booster(3, 2, seed=2, semantics=semantics).fit(data) for _ in range(2))
    assert one.alphas == two.alphas and len(one.alphas) == 2
    said = one.predict(data).select("id", "predict", "label").collect()
    assert sum(r.predict == r.label for r in said) >= 57


def test_booster_weights_by_hand(spark):
    """One round with equal losses: r = loss * (right - wrong share), and alpha by the formula."""
    data = learning.difficulty_loss(rows(spark, 30, noise=0.3), 1.0).withColumn("loss", F.lit(0.5))
    model = learning.Booster(3, 1, uniform=True, seed=3).fit(data)
    said = model.models[0].transform(data).select("label", "prediction").collect()
    right = sum(r.label == r.prediction for r in said) / 30
    r = 0.5 * (2 * right - 1)
    assert model.alphas == [pytest.approx(0.5 * math.log((1 + r) / (1 - r)) + math.log(2))]


def test_edges_of_boosting(spark):
    data = learning.difficulty_loss(rows(spark, 12), 1.0)
    assert learning.Booster(3, 2).fit(data.limit(0)).predict(data).where("predict IS NOT NULL").count() == 0
    assert learning.Booster(1, 2).fit(data.where("label = 0")).models == []
    with pytest.raises(ValueError, match="semantics"):
        learning.Booster(3, semantics="other").fit(data)


@pytest.mark.parametrize("name", ["svm", "forest", "tree", "bayes", "knn", "mlp", "logistic"])
def test_baselines(spark, name):
    data = learning.difficulty_loss(rows(spark, 45), 1.0)
    train, test = data.where("fold <> 0"), data.where("fold = 0")
    found = learning.results(learning.trainer(name, 3)(train, test)).collect()
    assert len(found) == 15 and sum(r.detail for r in found) >= 12


def test_nearest_against_brute_force(spark):
    data = rows(spark, 50, noise=0.4).select("id", "item", "label", "features")
    train, test = data.where("id % 3 <> 0"), data.where("id % 3 = 0")
    got = {r.id: r.predict for r in learning.nearest(train, test, 3, block=9).collect()}
    held = train.collect()
    for x in test.collect():
        near = sorted(held, key=lambda t: (x.features.squared_distance(t.features), t.id))[:3]
        votes = [t.label for t in near]
        assert got[x.id] == min(set(votes), key=lambda c: (-votes.count(c), c))


def test_experiments_by_number_and_summary(spark):
    assert learning.EXPERIMENTS[0] == "boost" and len(learning.EXPERIMENTS) == 7
    found = learning.cross_validate(rows(spark, 30), learning.trainer(3, 3), 3)
    assert set(learning.summary(found)) == {"accuracy", "variance", "errors", "error_loss", "credibility"}
    assert learning.hold_out(rows(spark, 30), learning.trainer("tree", 3)).count() == 10
    data = rows(spark, 30)
    assert learning.forest_accuracy(data, data) == 1


def test_command_line(spark, tmp_path, capsys):
    r = random.Random(2)
    nt, train, test = [], ["thing\tkind"], ["thing\tkind"]
    for k in range(36):
        x = f"http://x/n{k}"
        nt += [f"<{x}> <http://x/is> <http://x/c{k % 2}> .", f"<{x}> <http://x/kind> <http://x/k{k % 2}> .", f'<{x}> <http://x/size> "{r.randrange(5)}" .']
        nt += [f"<{x}> <http://x/near> <http://x/z{j}> ." for j in range(k % 5)]  # nodes of different degrees
        (train if k % 3 else test).append(f"{x}\t{'ab'[k % 2]}")
    (tmp_path / "toy.nt").write_text("\n".join(nt) + "\n")
    (tmp_path / "trainingSet.tsv").write_text("\n".join(train) + "\n")
    (tmp_path / "testSet.tsv").write_text("\n".join(test) + "\n")
    common = ["--folder", str(tmp_path), "--dataset", "toy", "--label", "kind", "--item", "thing", "--exclude", "http://x/kind"]
    out = cli.main(["run", *common, "--folds", "2", "--rounds", "2", "--count", "--level", "--out", str(tmp_path / "out"), "--flag", "0"])
    assert out["accuracy"] > 0.9 and json.loads(capsys.readouterr().out.splitlines()[-1]) == out
    features = spark.read.parquet(str(tmp_path / "out" / "features"))
    assert features.select("noi").distinct().count() == 36 and not features.where(F.contains("feature", F.lit("kind"))).count()
    got = cli.main(["update", *common, "--entities", "1"])
    assert got["cells"] == got["columns"] == 0
    with pytest.raises(SystemExit, match="missing"):
        cli.main(["run", *common, "--graph", "none.nt"])
