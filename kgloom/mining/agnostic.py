"""Rules between relations without labels: itemsets over (rel, a, b) pairs and their association metrics.

Relations are whole property paths, `a` is a node of interest and `b` a value. Items are patterns as text: `?a r ?b`,
`?b r ?a` and, for chains, `?k r1 ?a & ?k r2 ?b`.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.operators import rules
from kgloom.shared import written


def relation_pairs(nbh: DataFrame) -> DataFrame:
    """(rel, a, b) of a neighbourhood: distinct pairs of node and value of each path."""
    return nbh.select(F.col("path").alias("rel"), F.col("noi").alias("a"), F.col("value").alias("b")).distinct()


def feature_pairs(features: DataFrame) -> DataFrame:
    """(rel, a, b) of binary features: those called rel§value; features without the mark belong to no relation."""
    marked = features.where(F.contains("feature", F.lit("§")))
    name = F.substring_index("feature", "§", 1)
    return marked.select(name.alias("rel"), F.col("noi").alias("a"), F.expr("substring(feature, length(substring_index(feature, '§', 1)) + 2)").alias("b")).distinct()


def column_supports(features: DataFrame) -> DataFrame:
    """(feature, support): in how many nodes' rows a feature is true."""
    return features.select("noi", "feature").distinct().groupBy("feature").agg(F.count("*").alias("support"))


def relation_supports(features: DataFrame) -> DataFrame:
    """(rel, support): the sum of the supports of a relation's rel§value features."""
    rel = F.substring_index("feature", "§", 1).alias("rel")
    return column_supports(features).where(F.contains("feature", F.lit("§"))).groupBy(rel).agg(F.sum("support").alias("support"))


def supported(pairs: DataFrame, support: int) -> DataFrame:
    """The pairs of relations that have at least `support` of them."""
    often = pairs.groupBy("rel").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("rel")
    return pairs.join(often, "rel", "left_semi")


def colons(rel: Column) -> Column:
    """The length of a path of full IRIs: its colons, one for each hop."""
    return F.length(rel) - F.length(F.replace(rel, F.lit(":"), F.lit("")))


def dots(rel: Column) -> Column:
    """The length of a path of names without dots."""
    return F.length(rel) - F.length(F.replace(rel, F.lit("."), F.lit(""))) + 1


def arrangements(n: int, r: int) -> int:
    """How many ordered choices of r out of n there are: the size of a space of candidates."""
    return math.perm(n, r)


def itemsets(pairs: DataFrame, support: int, longest: int = 5, complexity: int = 2, length: Callable[[Column], Column] = colons) -> DataFrame:
    """(kind, x, y, support) of the patterns with at least `support` pairs of (a, b); y is null for single items.

    complexity 0: single relations only; from 1 on pairs (the same way, inverse) and triples, from 2 on chains too. Two
    relations of a pair are at most `longest` long together; a triple's third relation has length 1 and all three are at
    most `longest` long; a chain's two are at most `longest` - 1 long together, each of its three below `longest` - 1."""
    pairs = written(supported(pairs.distinct(), support), "pairs")
    item = lambda s, r, o: F.concat(F.lit(f"?{s} "), r, F.lit(f" ?{o}"))
    none = F.lit(None).cast("string")
    size = lambda c: length(F.col(c))
    one = rules.singles(pairs, support)
    kinds = [one.select(F.lit("single").alias("kind"), item("a", F.col("rel"), "b").alias("x"), none.alias("y"), "support"), one.select(F.lit("single").alias("kind"), item("b", F.col("rel"), "a").alias("x"), none.alias("y"), "support")]
    if complexity >= 1:
        ab = lambda c: item("a", F.col(c), "b")
        both = rules.conjunctions(pairs, support).where(size("rel1") + size("rel2") <= longest)
        kinds.append(both.select(F.lit("pair").alias("kind"), ab("rel1").alias("x"), ab("rel2").alias("y"), "support"))
        turned = rules.inverses(pairs, support).where(size("rel1") + size("rel2") <= longest)
        kinds.append(turned.select(F.lit("inverse").alias("kind"), ab("rel1").alias("x"), item("b", F.col("rel2"), "a").alias("y"), "support"))
        three = rules.triples(pairs, support).where((size("rel3") == 1) & (size("rel1") + size("rel2") + size("rel3") <= longest))
        two = F.concat(ab("rel1"), F.lit(" & "), ab("rel2"))
        three = three.select(two.alias("x"), ab("rel3").alias("y"), "support", "antecedent")
        kinds.append(three.select(F.lit("triple").alias("kind"), "x", "y", "support"))
        kinds.append(three.groupBy("x").agg(F.max("antecedent").alias("support")).select(F.lit("antecedent").alias("kind"), "x", none.alias("y"), "support"))
    if complexity >= 2:
        for shared, end in (("subject", ("k", "a", "k", "b")), ("object", ("a", "k", "b", "k"))):
            short = pairs.where(size("rel") < longest - 1)
            found = rules.chains(short, support, shared).where(size("rel1") + size("rel2") <= longest - 1)
            left = F.concat(item(end[0], F.col("rel1"), end[1]), F.lit(" & "), item(end[2], F.col("rel2"), end[3]))
            found = written(found.select(left.alias("x"), item("a", F.col("rel3"), "b").alias("y"), "support", "antecedent"), "chains")
            kinds.append(found.select(F.lit(f"chain_{shared}").alias("kind"), "x", "y", "support"))
            kinds.append(found.groupBy("x").agg(F.max("antecedent").alias("support")).select(F.lit("antecedent").alias("kind"), "x", none.alias("y"), "support"))
    out = kinds[0]
    for frame in kinds[1:]:
        out = out.unionByName(frame)
    return out


def association_rules(found: DataFrame, least: float = 0.0) -> DataFrame:
    """(antecedent, consequent, support, antecedent_support, consequent_support, confidence, lift, leverage, conviction):
    both splits of every itemset of two, with at least `least` support. Supports are absolute, so lift, leverage and
    conviction aren't on their usual scale; conviction is null where confidence is 1."""
    known = found.where("y IS NULL").groupBy("x").agg(F.max("support").alias("n"))
    two = found.where("y IS NOT NULL").groupBy("x", "y").agg(F.max("support").alias("support")).where(F.col("support") >= least)
    names = ("antecedent", "consequent")
    every = two.select(F.col("x").alias(names[0]), F.col("y").alias(names[1]), "support").unionByName(two.where("x <> y").select(F.col("y").alias(names[0]), F.col("x").alias(names[1]), "support"))
    for name in names:
        every = every.join(known.select(F.col("x").alias(name), F.col("n").alias(f"{name}_support")), name)
    return every.select(*names, "support", *[f"{n}_support" for n in names], *rules.metrics(F.col("support"), *[F.col(f"{n}_support") for n in names]))


def mine(pairs: DataFrame, support: int = 10, longest: int = 5, complexity: int = 2, length: Callable[[Column], Column] = colons) -> DataFrame:
    """The association rules of (rel, a, b) pairs."""
    return association_rules(written(itemsets(pairs, support, longest, complexity, length), "itemsets"))
