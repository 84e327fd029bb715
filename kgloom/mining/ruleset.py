"""Rule sets for a label: candidates from forests, screening, and a Bayesian search by annealing chains.

A rule is a conjunction of features, a rule set a disjunction of rules. Candidates are all root-to-leaf paths of random
forests, their features taken as true; rules are screened by what they cover, and chains walk over sets of the rules that
are left. Chains run side by side in tasks; each needs the coverage of at most `max_rules` rules over the distinct kinds
of rows (rows that the same rules cover, with the same label, are one kind with a count), of a size that is checked.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.functions.boosting import confusion
from kgloom.operators import rules as rule_ops
from kgloom.shared import written

#: Bytes of coverage that a chain's task may hold.
COVERAGE_BYTES = 256 << 20


def _lbb(k, n, a: float, b: float):
    """The logarithm of the beta-binomial weight, without the coefficient."""
    g = np.vectorize(math.lgamma, otypes=[float])
    return math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + g(np.asarray(k) + a) + g(np.asarray(n) - k + b) - g(np.asarray(n) + a + b)


@dataclass
class Priors:
    """Sizes of the pattern space by rule length, and Beta priors: for each length (alpha, beta), and of the likelihoods."""

    columns: int
    longest: int
    alpha: float = 100.0
    beta: float = 1.0
    spaces: list[float] = field(default_factory=list)
    alphas: list[float] = field(default_factory=list)
    betas: list[float] = field(default_factory=list)

    def __post_init__(self):
        self.spaces = [float(math.comb(self.columns, k)) for k in range(1, self.longest + 1)]
        self.alphas = self.alphas or [1.0] * self.longest
        self.betas = self.betas or [100.0 * x + 1 for x in self.spaces]

    def prior(self, lengths: Sequence[int]) -> float:
        """The logarithm of a rule set's prior from its rules' lengths."""
        counts = np.bincount(np.asarray(lengths, int), minlength=self.longest + 1)[1 : self.longest + 1]
        return float(sum(_lbb(int(c), s, a, b) for c, s, a, b in zip(counts, self.spaces, self.alphas, self.betas, strict=True)))

    def score(self, lengths: Sequence[int], tp: int, fp: int, tn: int, fn: int) -> float:
        """The logarithm of a rule set's posterior, up to a constant."""
        return self.prior(lengths) + float(_lbb(tp, tp + fp, self.alpha, self.beta)) + float(_lbb(tn, tn + fn, self.alpha, self.beta))

    def bounds(self, positives: int, negatives: int) -> dict[str, object]:
        """The empty set's prior, the best likelihood, and what the first rule of each length costs at most: bounds for pruning, which the chains don't need."""
        empty = self.prior([])
        return {"empty": empty, "best_likelihood": float(_lbb(positives, positives, self.alpha, self.beta) + _lbb(negatives, negatives, self.alpha, self.beta)), "first_rule": [self.prior([k]) - empty for k in range(1, self.longest + 1)]}


_NODE = re.compile(r"^(\s*)(Tree|If|Else|Predict)(?:.*?feature (\d+))?")


def paths_of_trees(described: str) -> set[frozenset[int]]:
    """The sets of features on the root-to-leaf paths of a forest, from its description; a tree of one leaf has the empty set."""
    out, path = set(), []
    for line in described.splitlines():
        found = _NODE.match(line)
        if not found:
            continue
        depth, kind = len(found[1]), found[2]
        if kind == "Tree":
            path = []
            continue
        path = [x for x in path if x[0] < depth]
        if kind == "Predict":
            out.add(frozenset(f for _, f in path))
        else:
            path.append((depth, int(found[3])))
    return out


def candidates(vectors: DataFrame, names: Sequence[str], longest: int, forest_size: int = 1000, seed: int = 0, criterion: str = "gini") -> list[frozenset[str]]:
    """Rules of up to `longest` features: for each length the paths of a forest of that depth, of forest_size * length trees, fitted on (features, label) rows. A tree of one leaf gives one feature, drawn by the seed."""
    from pyspark.ml.classification import RandomForestClassifier

    rng, out = np.random.default_rng(seed), set()
    for depth in range(1, longest + 1):
        forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=forest_size * depth, maxDepth=depth, impurity=criterion, seed=seed + depth, featureSubsetStrategy="sqrt")
        for found in paths_of_trees(forest.fit(vectors).toDebugString):
            out.add(frozenset(names[k] for k in found) or frozenset([names[int(rng.integers(len(names)))]]))
    return sorted(out, key=lambda r: (len(r), sorted(r)))


def rule_frame(spark, found: Sequence[frozenset[str]]) -> DataFrame:
    """(rule, feature) rows."""
    return spark.createDataFrame([(k, f) for k, rule in enumerate(found) for f in sorted(rule)], "rule int, feature string")


@dataclass
class Kinds:
    """Rows by kind: which rules cover them (kinds x rules), label and count."""

    cover: np.ndarray
    label: np.ndarray
    count: np.ndarray

    def confusion(self, chosen: Sequence[int]) -> tuple[int, int, int, int]:
        hit = self.cover[:, list(chosen)].any(axis=1) if len(chosen) else np.zeros(len(self.label), bool)
        n, y = self.count, self.label == 1
        return int(n[hit & y].sum()), int(n[hit & ~y].sum()), int(n[~hit & ~y].sum()), int(n[~hit & y].sum())


def kinds_of_rows(features: DataFrame, rules: DataFrame, labels: DataFrame, n_rules: int) -> Kinds:
    """The kinds of labelled rows under rules numbered from 0; raises if they take over COVERAGE_BYTES."""
    cover = rule_ops.coverage(features, rules)
    rows = labels.join(cover.groupBy("noi").agg(F.sort_array(F.collect_set("rule")).alias("held")), "noi", "left")
    kinds = written(rows.groupBy(F.coalesce("held", F.array().cast("array<int>")).alias("held"), "label").agg(F.count("*").alias("n")), "kinds")
    if (n := kinds.count()) * (n_rules + 16) > COVERAGE_BYTES:
        raise ValueError(f"{n} kinds of rows under {n_rules} rules take over {COVERAGE_BYTES} bytes: take fewer rules")
    got = kinds.orderBy("held", "label").collect()  # of the size just checked
    matrix = np.zeros((len(got), n_rules), bool)
    for k, row in enumerate(got):
        matrix[k, list(row.held)] = True
    return Kinds(matrix, np.array([r.label for r in got], np.int8), np.array([r.n for r in got], np.int64))


class Chain:
    """One annealing chain over sets of rules."""

    def __init__(self, kinds: Kinds, rules: Sequence[frozenset], priors: Priors, greed: float, rng: np.random.Generator):
        self.kinds, self.rules, self.priors, self.q, self.rng = kinds, list(rules), priors, greed, rng
        self.sizes = [len(r) for r in rules]

    def score(self, chosen: Sequence[int]) -> float:
        return self.priors.score([self.sizes[r] for r in chosen], *self.kinds.confusion(chosen))

    def _quality(self, chosen: Sequence[int]) -> float:
        tp, fp, *_ = self.kinds.confusion(chosen)
        return tp / (tp + fp + 1)

    def _cut(self, chosen: list[int], row: int) -> list[int]:
        if not chosen:
            return chosen
        if self.rng.random() < self.q:
            able = [r for r in chosen if self.kinds.cover[row, r]] or chosen
            gone = able[int(self.rng.integers(len(able)))]
        else:
            left = np.array([self._quality([x for x in chosen if x != r]) for r in chosen])
            weight = np.exp(left - left.min())
            gone = chosen[int(self.rng.choice(len(chosen), p=weight / weight.sum()))]
        return [r for r in chosen if r != gone]

    def _add(self, chosen: list[int]) -> list[int]:
        if self.rng.random() < self.q:
            new = int(self.rng.integers(len(self.rules)))
        else:
            free = ~self.kinds.cover[:, chosen].any(axis=1) if chosen else np.ones(len(self.kinds.label), bool)
            n, y = self.kinds.count[free], self.kinds.label[free] == 1
            tp, fp = (n * y) @ self.kinds.cover[free], (n * ~y) @ self.kinds.cover[free]
            value = tp / (tp + fp + 1)
            best = np.flatnonzero(value == value.max())
            new = int(best[self.rng.integers(len(best))])
        return chosen if new in chosen else [*chosen, new]

    def _normal(self, chosen: list[int]) -> list[int]:
        keep = set(rule_ops.normalised([self.rules[r] for r in chosen]))
        out = []
        for r in chosen:
            if self.rules[r] in keep:
                keep.discard(self.rules[r])
                out.append(r)
        return out

    def _clean(self, chosen: list[int]) -> list[int]:
        """Without rules that the others make needless, as long as a positive is left predicted."""
        out = list(chosen)
        for r in chosen:
            rest = [x for x in out if x != r]
            if rest and self.kinds.confusion(rest)[0] > 0 and self.kinds.confusion(rest) == self.kinds.confusion(out):
                out = rest
        return out

    def propose(self, chosen: list[int]) -> list[int]:
        hit = self.kinds.cover[:, chosen].any(axis=1) if chosen else np.zeros(len(self.kinds.label), bool)
        wrong = np.flatnonzero(hit != (self.kinds.label == 1))
        if not len(wrong):
            return self._clean(chosen)
        share = self.kinds.count[wrong] / self.kinds.count[wrong].sum()
        row = int(wrong[self.rng.choice(len(wrong), p=share)])
        half = self.rng.random() < 0.5
        if self.kinds.label[row] == 1 or len(chosen) <= 1:
            out = self._add(chosen) if half or len(chosen) <= 1 else self._add(self._cut(chosen, row))
        else:
            out = self._cut(chosen, row) if half else self._add(self._cut(chosen, row))
        return self._normal(out)

    def run(self, steps: int, start: float = 1000.0) -> tuple[float, list[int]]:
        """The best score and its rules. From 70 % of the steps on each step may start anew from the history, later entries likelier."""
        most = min(8, len(self.rules))
        n = int(self.rng.integers(1, most)) if most > 1 else 1
        now = [int(x) for x in self.rng.choice(len(self.rules), n, replace=False)]
        score = self.score(now)
        history = [(score, now)]
        for step in range(steps):
            if step >= 0.7 * steps:
                weight = np.arange(1, len(history) + 1)
                score, now = history[int(self.rng.choice(len(history), p=weight / weight.sum()))]
            new = self.propose(list(now))
            value, heat = self.score(new), start ** (1 - step / steps)
            if value > history[-1][0]:
                history.append((value, new))
            if self.rng.random() <= math.exp(min(0.0, (value - score) / heat)):
                now, score = new, value
        return history[-1]


def search(spark, kinds: Kinds, rules: Sequence[frozenset], priors: Priors, chains: int, steps: int, greed: float, seed: int = 0) -> tuple[float, list[int]]:
    """The best (score, rules) over all chains, ties to the first one. The coverage is broadcast; its size was checked."""
    sent = spark.sparkContext.broadcast((kinds, list(rules), priors))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k in batch["id"]:
                value, chosen = Chain(*sent.value, greed, np.random.default_rng([seed, int(k)])).run(steps)
                rows.append((int(k), value, chosen))
            yield pd.DataFrame(rows, columns=["chain", "score", "rules"])

    parts = max(1, min(chains, spark.sparkContext.defaultParallelism * 2))
    found = spark.range(0, chains, 1, parts).mapInPandas(run, "chain long, score double, rules array<int>")
    best = found.agg(F.max_by(F.struct("score", "rules"), F.struct("score", -F.col("chain"))).alias("best")).first().best
    return best.score, list(best.rules)


def text_of(rule: frozenset[str], attributes: Sequence[str] = ()) -> str:
    """A rule for reading; `a<b` is written `a<=b` where b is an attribute's name."""
    shown = []
    for item in sorted(rule):
        left, sign, right = item.partition("<")
        shown.append(f"{left}<={right}" if sign and not right.startswith("=") and right in attributes else item)
    return " AND ".join(shown)


@dataclass
class RuleSetMiner:
    """fit(features, labels) searches a rule set for the label; fit(features) mines rules between relations."""

    support: float = 10
    max_rules: int = 2000
    max_len_rule_set: int = 5
    max_iter: int = 10
    chains: int = 1000
    forest_size: int = 1000
    criteria: str = "precision"
    rule_complexity: int = 2
    propose_threshold: float = 0.1
    seed: int = 0

    def fit(self, features: DataFrame, labels: DataFrame | None = None):
        """Task-agnostic: the association rules as a frame. With (noi, label 0/1) labels: (accuracy, rules)."""
        from kgloom.mining import agnostic

        if labels is None:
            return agnostic.mine(agnostic.feature_pairs(features), int(self.support), self.max_len_rule_set, self.rule_complexity)
        return self._fit_labelled(features, labels)

    def _fit_labelled(self, features: DataFrame, labels: DataFrame) -> tuple[float, list[frozenset[str]]]:
        from kgloom.learning import vectors

        spark = features.sparkSession
        frame, names = vectors(features, labels)
        found = candidates(frame, names, self.max_len_rule_set, self.forest_size, self.seed)
        given = written(rule_frame(spark, found), "candidates")
        screened = rule_ops.enough_positives(rule_ops.screen(features, given, labels), self.support)
        kept = [r.rule for r in rule_ops.chosen(screened, self.criteria, int(self.max_rules)).select("rule").collect()]
        self.rules, self.score = [], -math.inf
        if kept:
            rules = [found[k] for k in kept]
            kinds = kinds_of_rows(features, rule_frame(spark, rules), labels, len(rules))
            priors = Priors(len(names), self.max_len_rule_set)
            self.score, best = search(spark, kinds, rules, priors, self.chains, self.max_iter, self.propose_threshold, self.seed)
            self.rules = [rules[k] for k in best]
        said = self.predict(features, labels.select("noi")).join(labels, "noi")
        c = confusion(said).first()
        return (c.tp + c.tn) / max(1, c.tp + c.tn + c.fp + c.fn), self.rules

    def predict(self, features: DataFrame, nodes: DataFrame) -> DataFrame:
        """(noi, predicted) by the rules found; without rules all 0."""
        if not self.rules:
            return nodes.select("noi").distinct().select("noi", F.lit(0).cast("long").alias("predicted"))
        return rule_ops.predict(features, rule_frame(features.sparkSession, self.rules), nodes)

    def print_rules(self, attributes: Sequence[str] = ()) -> list[str]:
        """The rules for reading, a line each."""
        lines = [text_of(rule, attributes) for rule in self.rules]
        print("\n".join(lines))
        return lines
