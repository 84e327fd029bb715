"""Learners over feature matrices: boosting that minds how hard nodes are, its baselines, and evaluation over folds.

Rows are (id, item, label, difficult, features): `id` orders the training rows, `label` counts from 0, `features` is a
sparse vector. Models are pyspark.ml's; what comes to the driver is models and single sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions import boosting
from kgloom.functions.matrix import sparse_rows, vocabulary
from kgloom.operators import order
from kgloom.shared import written

RESULT = ("item", "sign", "difficult", "predict", "loss", "detail")


def vectors(cells: DataFrame, rows: DataFrame, names: DataFrame | None = None, val: str = "val") -> tuple[DataFrame, list[str]]:
    """The (noi, ...) rows with `features`, and the features' names by index. Names are those of `cells` unless given as (feature, index); they come to the driver, as a model's width does. Nodes without features get the zero vector."""
    if val not in cells.columns:
        cells = cells.withColumn(val, F.lit(1.0))
    names = written(vocabulary(cells) if names is None else names, "vocabulary")
    known = [r.feature for r in names.orderBy("index").collect()]
    width = len(known)
    pack = F.udf(lambda at, x: Vectors.sparse(width, at or [], x or []), VectorUDT())
    held = sparse_rows(cells.select("noi", "feature", F.col(val).alias("val")), names)
    return rows.join(held, "noi", "left").withColumn("features", pack("indices", "values")).drop("indices", "values"), known


def difficulty_loss(rows: DataFrame, pre: float) -> DataFrame:
    """The rows with `loss`, 1 / (1 + e^(pre * difficult)) min-max scaled over all of them."""
    raw = rows.withColumn("loss", 1 / (1 + F.exp(F.lit(float(pre)) * F.coalesce("difficult", F.lit(0.0)))))
    ends = raw.agg(F.min("loss").alias("__a"), F.max("loss").alias("__b"))
    scaled = F.coalesce(F.try_divide(F.col("loss") - F.col("__a"), F.col("__b") - F.col("__a")), F.lit(0.0))
    return raw.join(F.broadcast(ends)).withColumn("loss", scaled).drop("__a", "__b")  # one row


def logistic(weight: str = "copies", rows: int = 1) -> LogisticRegression:
    """Multinomial logistic regression with the ridge of strength 1 over `rows` rows."""
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol=weight, family="multinomial", maxIter=100, tol=1e-4, regParam=1.0 / max(1, rows), elasticNetParam=0.0, standardization=False)


@dataclass
class Booster:
    """Rounds of weighted bootstrap, a logistic regression, its say alpha, and new weights.

    semantics="clean": a round's model is held against the whole training set, all rows get new weights that sum to 1.
    semantics="reference": drawn row j is held against the label of training row j, and only the first int(0.666 n) rows
    get new weights, scaled by their own sum.

    Rounds in which a bootstrap has one class only, or whose alpha isn't finite, take no part in the vote."""

    classes: int
    rounds: int = 100
    pre: float = 1.0
    seed: int = 0
    semantics: str = "clean"
    uniform: bool = False
    models: list = field(default_factory=list)
    alphas: list[float] = field(default_factory=list)

    def fit(self, train: DataFrame) -> Booster:
        """Fits on (id, label, features, loss) rows."""
        if self.semantics not in ("clean", "reference"):
            raise ValueError("semantics is clean or reference")
        self.models, self.alphas = [], []
        base = written(order.positions(train, "id").withColumnRenamed("pos", "row"), "boost-train")
        n = base.count()
        if not n:
            return self
        draws = int(0.666 * n)
        if self.uniform:
            weights = base.select("row", F.lit(1.0 / n).alias("d"))
        else:
            total = base.agg(F.sum("loss")).first()[0]
            weights = base.select("row", (F.col("loss") / F.lit(total) if total else F.lit(1.0 / n)).alias("d"))
        weights = written(weights, "boost-weights")
        for turn in range(self.rounds):
            whole = weights.select("row", F.round(F.col("d") * F.lit(float(1 << 40))).cast("long").alias("own"))
            drawn = written(order.random_draws(whole, "own", draws, self.seed * 1_000_003 + turn, "row"), "boost-draws")  # rows count from 1, as positions do
            copies = drawn.groupBy("pos").agg(F.count("*").alias("copies"))
            sample = base.join(copies, F.col("row") == F.col("pos")).select("features", F.col("label").cast("double").alias("label"), F.col("copies").cast("double").alias("copies"))
            if sample.select("label").distinct().count() < 2:
                continue
            model = logistic(rows=draws).fit(sample)
            said = model.transform(base).select("row", "label", "loss", F.col("prediction").cast("long").alias("said"))
            if self.semantics == "reference":
                at = drawn.select((F.col("draw") + 1).alias("row"), F.col("pos").alias("other")).join(said.select(F.col("row").alias("other"), F.col("said").alias("got")), "other")
                judged = base.select("row", "label", "loss").join(at, "row").select("row", "loss", F.when(F.col("label") == F.col("got"), 1).otherwise(-1).alias("right"))
            else:
                judged = said.select("row", "loss", F.when(F.col("label") == F.col("said"), 1).otherwise(-1).alias("right"))
            judged = written(judged.join(weights, "row"), "boost-judged")
            r = judged.agg(F.sum(F.col("d") * F.col("right") * F.col("loss"))).first()[0] or 0.0
            if not -1 < r < 1:
                continue
            alpha = 0.5 * math.log((1 + r) / (1 - r)) + (math.log(self.classes - 1) if self.classes > 1 else 0.0)
            new = judged.select("row", (F.col("d") * F.exp(F.lit(-alpha) * F.col("right") * F.col("loss"))).alias("e"))
            z = new.agg(F.sum("e")).first()[0]
            updated = weights.join(new, "row", "left").select("row", F.coalesce(F.col("e") / F.lit(z), "d").alias("d"))
            weights = written(updated, "boost-weights")
            self.models.append(model)
            self.alphas.append(alpha)
        return self

    def predict(self, rows: DataFrame, key: str = "id") -> DataFrame:
        """The rows with `predict`, the class with the largest sum of alphas, and null where no sum is over 0."""
        votes = None
        for model, alpha in zip(self.models, self.alphas, strict=True):
            own = model.transform(rows).select(key, F.col("prediction").cast("long").alias("class"), F.lit(alpha).alias("alpha"))
            votes = own if votes is None else votes.unionByName(own)
        if votes is None:
            return rows.withColumn("predict", F.lit(None).cast("long"))
        best = boosting.vote(votes.withColumnRenamed(key, "item")).select(F.col("item").alias(key), F.col("predicted").alias("predict"))
        return rows.join(best, key, "left")


def results(predicted: DataFrame) -> DataFrame:
    """(item, sign, difficult, predict, loss, detail): detail is 1 where the prediction is right; no prediction is wrong."""
    detail = F.when(F.col("label") == F.col("predict"), 1).otherwise(0).cast("long")
    return predicted.select("item", F.col("label").cast("long").alias("sign"), "difficult", "predict", "loss", detail.alias("detail"))


def boosted(classes: int, rounds: int, pre: float, seed: int = 0, semantics: str = "clean", uniform: bool = False) -> Callable:
    """A trainer for `cross_validate`: (train, test) rows to the test rows with `predict`."""

    def train_and_predict(train: DataFrame, test: DataFrame) -> DataFrame:
        return Booster(classes, rounds, pre, seed, semantics, uniform).fit(train).predict(test)

    return train_and_predict


def nearest(train: DataFrame, test: DataFrame, k: int = 5, block: int = 2000) -> DataFrame:
    """The test rows with `predict`, the commonest class among the k nearest training rows by Euclidean distance, ties to the smaller class. Blocks of test rows meet blocks of training rows; each pair of blocks gives k rows a test row."""
    import numpy as np
    import pandas as pd

    blocks = lambda df: max(1, -(-df.count() // block))
    n, m = blocks(train), blocks(test)
    key = F.xxhash64("id")
    parts = F.udf(lambda v: (v.indices.tolist(), v.values.tolist()) if hasattr(v, "indices") else (list(range(len(v))), v.values.tolist()), "struct<at: array<int>, x: array<double>>")
    held = train.select("id", "label", parts("features").alias("v"), F.pmod(key, F.lit(n)).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"), F.lit(False).alias("asks"))
    asked = test.select("id", "label", parts("features").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), F.pmod(key, F.lit(m)).alias("j"), F.lit(True).alias("asks"))
    both = held.unionByName(asked).select("id", "label", "i", "j", "asks", F.col("v.at").alias("at"), F.col("v.x").alias("x"))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        names = {a: k_ for k_, a in enumerate(sorted({a for at in rows["at"] for a in at}))}
        dense = np.zeros((len(rows), len(names)))
        for line, (at, x) in enumerate(zip(rows["at"], rows["x"], strict=True)):
            dense[line, [names[a] for a in at]] = x
        asks = rows["asks"].to_numpy(bool)
        one, two, ids, labels = dense[~asks], dense[asks], rows["id"].to_numpy(), rows["label"].to_numpy()
        out = []
        for line, own in zip(two, ids[asks], strict=True):
            far = ((one - line) ** 2).sum(axis=1)
            for at in np.lexsort((ids[~asks], far))[:k]:
                out.append((own, far[at], ids[~asks][at], int(labels[~asks][at])))
        return pd.DataFrame(out, columns=["id", "far", "other", "class"])

    near = both.groupBy("i", "j").applyInPandas(meet, "id long, far double, other long, class long")
    first = Window.partitionBy("id").orderBy("far", "other")
    top = near.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k)
    said = top.groupBy("id", "class").agg(F.count("*").alias("n")).groupBy("id").agg(F.min_by("class", F.struct(-F.col("n"), "class")).alias("predict"))
    return test.join(said, "id", "left")


def baseline(name: str, classes: int, seed: int = 0) -> Callable:
    """One of svm, forest, tree, bayes, knn, mlp, logistic, as a trainer for `cross_validate`."""

    def train_and_predict(train: DataFrame, test: DataFrame) -> DataFrame:
        if name == "knn":
            return nearest(train, test)
        train = train.withColumn("label", F.col("label").cast("double"))
        width = train.select("features").first().features.size
        model = {
            "svm": lambda: OneVsRest(classifier=LinearSVC(maxIter=100)),
            "forest": lambda: RandomForestClassifier(numTrees=10, seed=seed),
            "tree": lambda: DecisionTreeClassifier(maxDepth=10, seed=seed),
            "bayes": lambda: NaiveBayes(modelType="gaussian"),
            "mlp": lambda: MultilayerPerceptronClassifier(layers=[width, 100, max(2, classes)], maxIter=200, seed=seed),
            "logistic": lambda: logistic("one", train.count()),
        }[name]()
        fitted = model.fit(train.withColumn("one", F.lit(1.0)))
        said = fitted.transform(test).select("id", F.col("prediction").cast("long").alias("predict"))
        return test.join(said, "id", "left")

    return train_and_predict


#: What an experiment's number stands for: 0 is boosting, 1 to 6 are the baselines.
EXPERIMENTS = ("boost", "svm", "forest", "tree", "bayes", "knn", "mlp")


def trainer(experiment: int | str, classes: int, rounds: int = 100, pre: float = 1.0, seed: int = 0) -> Callable:
    """The trainer of an experiment, by number or name; also "adaboost" (uniform first weights) and "logistic"."""
    name = EXPERIMENTS[experiment] if isinstance(experiment, int) else experiment
    if name in ("boost", "adaboost"):
        return boosted(classes, rounds, pre, seed, uniform=name == "adaboost")
    return baseline(name, classes, seed)


def folded(rows: DataFrame, folds: int, block: int = 10, seed: int = 0) -> DataFrame:
    """(item, label, difficult, ...) rows with `id` and `fold`: sorted by difficulty, shuffled in blocks, dealt out in turn."""
    return order.shuffled_folds(rows, "difficult", "item", folds, F.xxhash64("item", F.lit(seed)), block)


def cross_validate(rows: DataFrame, train_and_predict: Callable, folds: int, pre: float = 1.0) -> DataFrame:
    """(item, sign, difficult, predict, loss, detail, fold): each fold predicted by what was trained on the others."""
    rows = written(difficulty_loss(rows, pre), "folds")
    out = None
    for fold in range(folds):
        train, test = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        own = written(results(train_and_predict(train, test)).withColumn("fold", F.lit(fold)), f"fold{fold}")
        out = own if out is None else out.unionByName(own)
    return out


def hold_out(rows: DataFrame, train_and_predict: Callable, parts: int = 3, pre: float = 1.0) -> DataFrame:
    """The results of one row in `parts` (by id), predicted by what was trained on the rest; nulls of the difficulty count as 0."""
    rows = written(difficulty_loss(rows.na.fill(0.0, ["difficult"]), pre), "hold-out")
    return results(train_and_predict(rows.where(F.col("id") % parts != 0), rows.where(F.col("id") % parts == 0)))


def summary(found: DataFrame) -> dict[str, float]:
    """Mean and population variance of the folds' accuracies, errors, and the errors' loss."""
    from kgloom.functions.credibility import credibility, fold_summary

    folds = fold_summary(found).first()
    loss = found.agg(F.coalesce(F.sum(F.when(F.col("detail") == 0, F.col("loss"))), F.lit(0.0))).first()[0]
    return {"accuracy": folds.mean_accuracy, "variance": folds.var_accuracy, "errors": folds.errors, "error_loss": loss, "credibility": credibility(found).first().cr}


def forest_accuracy(train: DataFrame, test: DataFrame, seed: int = 0, trees: int = 100) -> float:
    """The accuracy on `test` of a random forest fitted on `train`."""
    fitted = RandomForestClassifier(numTrees=trees, seed=seed).fit(train.withColumn("label", F.col("label").cast("double")))
    return fitted.transform(test).agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
