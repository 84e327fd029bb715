"""Rule mining over (rel, a, b) pairs, and coverage and screening of rules over features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.shared import written


def singles(pairs: DataFrame, support: int) -> DataFrame:
    """(rel, support) of relations with enough distinct pairs."""
    return pairs.distinct().groupBy("rel").agg(F.count("*").alias("support")).where(F.col("support") >= support)


def conjunctions(pairs: DataFrame, support: int) -> DataFrame:
    """(rel1, rel2, support): pairs that two relations share."""
    one = pairs.distinct()
    two = one.select(F.col("rel").alias("rel2"), "a", "b")
    both = one.withColumnRenamed("rel", "rel1").join(two, ["a", "b"]).where("rel1 < rel2")
    return both.groupBy("rel1", "rel2").agg(F.count("*").alias("support")).where(F.col("support") >= support)


def inverses(pairs: DataFrame, support: int) -> DataFrame:
    """(rel1, rel2, support): pairs of rel1 that rel2 has the other way round; a relation with itself is symmetry."""
    one = pairs.distinct()
    two = one.select(F.col("rel").alias("rel2"), F.col("b").alias("a"), F.col("a").alias("b"))
    both = one.withColumnRenamed("rel", "rel1").join(two, ["a", "b"]).where("rel1 <= rel2")
    return both.groupBy("rel1", "rel2").agg(F.count("*").alias("support")).where(F.col("support") >= support)


#: Rows of a key on one side that meet in one task.
_BLOCK = 2000


def _meetings(left: DataFrame, right: DataFrame, key: str, block: int) -> DataFrame:
    """The equi-join of (key, ...) frames whose keys may be hubs: a key's rows are cut into blocks on both sides, and every pair of blocks is a join key of its own."""
    sizes = left.groupBy(key).agg(F.count("*").alias("__l")).join(right.groupBy(key).agg(F.count("*").alias("__r")), key)
    hubs = written(sizes.where((F.col("__l") > block) | (F.col("__r") > block)).select(key, *[F.ceil(F.col(c) / block).cast("long").alias(n) for c, n in (("__l", "__lb"), ("__r", "__rb"))]), "hubs")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n, F.lit(1)) - 1))
    own = lambda df, n: F.pmod(F.xxhash64(*[c for c in df.columns if c != key]), F.coalesce(n, F.lit(1)))
    one = left.join(hubs, key, "left").withColumn("__i", own(left, F.col("__lb"))).withColumn("__j", every(F.col("__rb"))).drop("__lb", "__rb")
    two = right.join(hubs, key, "left").withColumn("__j", own(right, F.col("__rb"))).withColumn("__i", every(F.col("__lb"))).drop("__lb", "__rb")
    return one.join(two, [key, "__i", "__j"]).drop("__i", "__j")


def chain_ends(pairs: DataFrame, shared: str = "subject", block: int = _BLOCK) -> DataFrame:
    """(rel1, rel2, a, b): distinct ends of two relations that meet in a subject (k-rel1->a, k-rel2->b) or an object."""
    key, end = ("a", "b") if shared == "subject" else ("b", "a")
    one = pairs.distinct()
    left = one.select(F.col("rel").alias("rel1"), F.col(key).alias("k"), F.col(end).alias("a"))
    right = one.select(F.col("rel").alias("rel2"), F.col(key).alias("k"), F.col(end).alias("b"))
    return _meetings(left, right, "k", block).select("rel1", "rel2", "a", "b").distinct()


def chains(pairs: DataFrame, support: int, shared: str = "subject", block: int = _BLOCK) -> DataFrame:
    """(rel1, rel2, rel3, antecedent, support): ends of chain_ends, and how many of them rel3 links. Both counts are exact and at least `support`."""
    ends = written(chain_ends(pairs, shared, block), "chain-ends")
    before = ends.groupBy("rel1", "rel2").agg(F.count("*").alias("antecedent")).where(F.col("antecedent") >= support)
    linked = ends.join(pairs.distinct().withColumnRenamed("rel", "rel3"), ["a", "b"]).groupBy("rel1", "rel2", "rel3").agg(F.count("*").alias("support"))
    return linked.where(F.col("support") >= support).join(before, ["rel1", "rel2"]).select("rel1", "rel2", "rel3", "antecedent", "support")


def approximate_ends(pairs: DataFrame, shared: str = "subject") -> DataFrame:
    """(rel1, rel2, antecedent): a lower bound of the numbers of chain ends without listing them. Meeting points are
    taken in descending order of their products of ends; each adds its product less that of the ends seen before. Only
    distinct ends and their first meeting point are kept, in windows by pair of relations."""
    key, end = ("a", "b") if shared == "subject" else ("b", "a")
    one = pairs.distinct().select("rel", F.col(key).alias("k"), F.col(end).alias("e"))
    degree = one.groupBy("rel", "k").agg(F.count("*").alias("n"))
    names = lambda df, i: df.select(F.col("rel").alias(f"rel{i}"), "k", F.col("n").alias(f"n{i}"))
    met = names(degree, 1).join(names(degree, 2), "k").withColumn("product", F.col("n1") * F.col("n2"))
    order = Window.partitionBy("rel1", "rel2").orderBy(F.desc("product"), "k")
    met = met.withColumn("at", F.row_number().over(order))
    new = []
    for i in (1, 2):
        ends = met.select("rel1", "rel2", "k", "at").join(one.withColumnRenamed("rel", f"rel{i}"), [f"rel{i}", "k"])
        first = ends.groupBy("rel1", "rel2", "e").agg(F.min("at").alias("at"))
        new.append(first.groupBy("rel1", "rel2", "at").agg(F.count("*").alias(f"new{i}")))
    rows = met.join(new[0], ["rel1", "rel2", "at"], "left").join(new[1], ["rel1", "rel2", "at"], "left").na.fill(0, ["new1", "new2"])
    seen = (F.col("n1") - F.col("new1")) * (F.col("n2") - F.col("new2"))
    return rows.groupBy("rel1", "rel2").agg(F.sum(F.col("product") - seen).alias("antecedent"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """(rel1, rel2, support) as both rel1 => rel2 and rel2 => rel1: a rule for each split."""
    return pairs.unionByName(pairs.select(F.col("rel2").alias("rel1"), F.col("rel1").alias("rel2"), "support"))


def metrics(both: Column, x: Column, y: Column) -> list[Column]:
    """Confidence, lift, leverage and conviction of x => y from absolute supports; conviction is null where confidence is 1."""
    confidence = both / x
    return [confidence.alias("confidence"), (confidence / y).alias("lift"), (both - x * y).cast("double").alias("leverage"), F.when(both < x, (1 - y) / (1 - confidence)).alias("conviction")]


def coverage(features: DataFrame, rules: DataFrame) -> DataFrame:
    """(noi, rule): nodes that have all features of a rule. rules is (rule, feature)."""
    size = rules.distinct().groupBy("rule").agg(F.count("*").alias("n_items"))
    held = features.distinct().join(rules.distinct(), "feature").groupBy("noi", "rule").agg(F.count("*").alias("n"))
    return held.join(size, "rule").where("n = n_items").select("noi", "rule")


def screen(features: DataFrame, rules: DataFrame, labels: DataFrame) -> DataFrame:
    """(rule, tp, fp, tn, fn, precision, specificity, sensitivity, f1) against labels (noi, label 0/1); a ratio without cases is null."""
    totals = labels.agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    hits = coverage(features, rules).join(labels, "noi").groupBy("rule").agg(F.sum("label").alias("tp"), F.sum(1 - F.col("label")).alias("fp"))
    every = rules.select("rule").distinct().join(hits, "rule", "left").na.fill(0, ["tp", "fp"])
    # totals is one row.
    out = every.join(F.broadcast(totals)).select("rule", "tp", "fp", (F.col("neg") - F.col("fp")).alias("tn"), (F.col("pos") - F.col("tp")).alias("fn"))
    ratio = lambda a, b, name: F.try_divide(a.cast("double"), b.cast("double")).alias(name)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return out.select("*", ratio(tp, tp + fp, "precision"), ratio(tn, tn + fp, "specificity"), ratio(tp, tp + fn, "sensitivity"), ratio(2 * tp, 2 * tp + fp + fn, "f1"))


def triples(pairs: DataFrame, support: int) -> DataFrame:
    """(rel1, rel2, rel3, antecedent, support): pairs that rel1 and rel2 share, and how many of them rel3 has as well. Both are at least `support`."""
    one = pairs.distinct()
    both = one.withColumnRenamed("rel", "rel1").join(one.select(F.col("rel").alias("rel2"), "a", "b"), ["a", "b"]).where("rel1 < rel2")
    before = conjunctions(pairs, support).withColumnRenamed("support", "antecedent")
    all_ = both.join(one.select(F.col("rel").alias("rel3"), "a", "b"), ["a", "b"]).where("rel3 <> rel1 AND rel3 <> rel2")
    found = all_.groupBy("rel1", "rel2", "rel3").agg(F.count("*").alias("support")).where(F.col("support") >= support)
    return found.join(before, ["rel1", "rel2"]).select("rel1", "rel2", "rel3", "antecedent", "support")


def gain_ratio(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    """The share of the labels' entropy that a rule takes away; 0 where the labels have none."""

    def entropy(p: Column) -> Column:
        return F.when((p > 0) & (p < 1), -p * F.log(p) - (1 - p) * F.log(1 - p)).otherwise(0.0)

    n = (tp + fp + tn + fn).cast("double")
    share = F.try_divide(tp + fp, n)
    left = share * entropy(F.try_divide(tp, tp + fp)) + (1 - share) * entropy(F.try_divide(fn, fn + tn))
    whole = entropy(F.try_divide(tp + fn, n))
    return F.coalesce(F.try_divide(whole - left, whole), F.lit(0.0))


def best(screened: DataFrame, criterion: str, k: int) -> DataFrame:
    """The k rules that are best by a column, ties to the smaller rule; a null ratio comes last."""
    return screened.orderBy(F.col(criterion).desc_nulls_last(), "rule").limit(k)


def predict(features: DataFrame, rules: DataFrame, nodes: DataFrame) -> DataFrame:
    """(noi, predicted): 1 where any rule has all its features. A feature that no node has is false, but for count.* with <, which is true."""
    known = features.select("feature").distinct().withColumn("__known", F.lit(True))
    lenient = F.col("__known").isNull() & F.col("feature").startswith("count.") & F.col("feature").contains("<")
    items = rules.distinct().join(known, "feature", "left").select("rule", "feature", lenient.alias("free"))
    size = items.groupBy("rule").agg(F.count(F.when(~F.col("free"), 1)).alias("n_items"))
    held = features.distinct().join(items.where("NOT free"), "feature").groupBy("noi", "rule").agg(F.count("*").alias("n"))
    some = held.join(size, "rule").where("n = n_items").select("noi").distinct().withColumn("__hit", F.lit(True))
    every = size.agg(F.coalesce(F.max(F.col("n_items") == 0), F.lit(False)).alias("__all"))
    out = nodes.select("noi").distinct().join(some, "noi", "left").join(F.broadcast(every))  # one row
    return out.select("noi", (F.col("__all") | F.coalesce("__hit", F.lit(False))).cast("long").alias("predicted"))


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function of x > 0: Stirling's series from x + 8 on, and the recurrence back."""
    x = x.cast("double")
    y = x + 8
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    # ln(2 * pi) / 2
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - F.log(product)


def log_beta_binomial(k: Column, n: Column, alpha: float, beta: float) -> Column:
    """The logarithm of the beta-binomial weight of k out of n, without the binomial coefficient."""
    a, b = F.lit(float(alpha)), F.lit(float(beta))
    return log_gamma(a + b) - log_gamma(a) - log_gamma(b) + log_gamma(k + a) + log_gamma(n - k + b) - log_gamma(n + a + b)


def enough_positives(screened: DataFrame, support: float) -> DataFrame:
    """The screened rules that cover at least `support` percent of the positives."""
    return screened.where(F.col("tp") * 100 >= F.lit(float(support)) * (F.col("tp") + F.col("fn")))


def chosen(screened: DataFrame, criterion: str, most: int) -> DataFrame:
    """At most `most` rules with `score`, best first by precision, specificity, sensitivity, f1 (also called mcc) or, for any other name, by gain ratio."""
    named = {"precision": "precision", "specificity": "specificity", "sensitivity": "sensitivity", "f1": "f1", "mcc": "f1"}
    score = F.col(named[criterion]) if criterion in named else gain_ratio(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])
    return screened.withColumn("score", score).orderBy(F.col("score").desc_nulls_last(), "rule").limit(most)


def normalised(rules: list[frozenset]) -> list[frozenset]:
    """A rule set without rules that contain another one's items: what they cover is covered. Equal rules stay once, in order."""
    out: list[frozenset] = []
    for k, rule in enumerate(rules):
        if not any(other < rule or (other == rule and at < k) for at, other in enumerate(rules)):
            out.append(rule)
    return out
