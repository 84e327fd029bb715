"""Queries of rule mining, screening, graph mutation and credibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions import credibility as cr
from kgloom.functions import features
from kgloom.operators import mutate, rules
from kgloom.plans.graph_queries import _GRAPH, _nbh
from kgloom.sources.tables import business_graph

_RULES = ((1, "inNation"), (1, "inNation§nation/3"), (2, "orderedBy"), (3, "inNation§nation/7"), (3, "orderedBy"), (4, "nowhere"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade between nations, and customers' parts."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lines = read("lineitem").join(read("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(read("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(read("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))

    def relation(name: str, kinds: tuple[str, str], ends: tuple[str, str], cond: str) -> DataFrame:
        a, b = (F.concat(F.lit(k + "/"), F.col(c).cast("string")) for k, c in zip(kinds, ends, strict=True))
        return lines.where(cond).select(F.lit(name).alias("rel"), a.alias("a"), b.alias("b"))

    found = relation("sells", ("nation", "nation"), ("s_nationkey", "c_nationkey"), "l_returnflag = 'R' AND l_quantity >= 45")
    found = found.unionByName(relation("buys", ("nation", "nation"), ("c_nationkey", "s_nationkey"), "l_returnflag = 'A' AND l_quantity >= 45"))
    for name, cond in (("bought", "true"), ("returned", "l_returnflag = 'R'"), ("bulk", "l_quantity >= 40")):
        found = found.unionByName(relation(name, ("customer", "part"), ("c_custkey", "l_partkey"), cond))
    return found.distinct()


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).where(F.col("rel").isin("sells", "buys"))


def r4_singles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.singles(_pairs(spark, sf_dir), 10)


def r5_conjunctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.conjunctions(_pairs(spark, sf_dir), 10)


def r5_inverses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.inverses(_trade(spark, sf_dir), 1)


def r6_chain_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.chains(_trade(spark, sf_dir), 1)


def r6_chain_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.chains(_trade(spark, sf_dir), 1, "object")


def a10_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    one = rules.singles(pairs, 10)
    both = rules.both_ways(rules.conjunctions(pairs, 10))
    both = both.join(one.select(F.col("rel").alias("rel1"), F.col("support").alias("x")), "rel1").join(one.select(F.col("rel").alias("rel2"), F.col("support").alias("y")), "rel2")
    return both.select("rel1", "rel2", "support", *[F.round(m, 6).alias(n) for m, n in zip(rules.metrics(F.col("support"), F.col("x"), F.col("y")), ("confidence", "lift", "leverage", "conviction"), strict=True)])


def r14_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("noi"), (F.col("c_mktsegment") == "BUILDING").cast("long").alias("label"))
    given = spark.createDataFrame(_RULES, "rule int, feature string")
    found = rules.screen(features.binary(_nbh(spark, sf_dir, 1)), given, labels)
    return found.select("rule", "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "specificity", "sensitivity", "f1")])


def s11_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutate.entity_triples(business_graph(spark, sf_dir), "nation/3")


def m1_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.createDataFrame([("nation/3",), ("customer/7",)], "node string")
    return mutate.delete_entities(business_graph(spark, sf_dir), gone).groupBy("p").agg(F.count("*").alias("n"))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' order counts as difficulty, and predictions that are wrong for every seventh key."""
    degree = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.count("*").alias("difficult"))
    detail = F.when(F.col("o_custkey") % 7 == 0, 0).otherwise(1).cast("long")
    return cr.scaled(degree, "difficult").select(F.col("o_custkey").alias("item"), "difficult", detail.alias("detail"), (F.col("o_custkey") % 10).alias("fold"))


def a17_credibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cr.credibility(_predicted(spark, sf_dir)).select(F.round("cr", 6).alias("cr"))


def a19_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cr.fold_summary(_predicted(spark, sf_dir))
    return found.select(F.round("mean_accuracy", 6).alias("mean_accuracy"), F.round("var_accuracy", 8).alias("var_accuracy"), "errors")


def b2_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cr.weights(_predicted(spark, sf_dir), 1.0).select("item", F.round("loss", 6).alias("loss"), F.round("weight", 8).alias("weight"))


QUERIES = {f.__name__: f for f in (r4_singles, r5_conjunctions, r5_inverses, r6_chain_subject, r6_chain_object, a10_metrics, r14_screen, s11_entity, m1_delete, a17_credibility, a19_folds, b2_weights)}

_P = """l AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
g AS (SELECT 'sells' AS rel, 'nation/' || s_nationkey AS a, 'nation/' || c_nationkey AS b FROM l WHERE l_returnflag = 'R' AND l_quantity >= 45
 UNION SELECT 'buys', 'nation/' || c_nationkey, 'nation/' || s_nationkey FROM l WHERE l_returnflag = 'A' AND l_quantity >= 45),
p AS (SELECT * FROM g UNION SELECT 'bought', 'customer/' || c_custkey, 'part/' || l_partkey FROM l
 UNION SELECT 'returned', 'customer/' || c_custkey, 'part/' || l_partkey FROM l WHERE l_returnflag = 'R'
 UNION SELECT 'bulk', 'customer/' || c_custkey, 'part/' || l_partkey FROM l WHERE l_quantity >= 40),
one AS (SELECT rel, count(*) AS support FROM p GROUP BY rel HAVING count(*) >= 10),
two AS (SELECT p1.rel AS rel1, p2.rel AS rel2, count(*) AS support FROM p p1 JOIN p p2 USING (a, b) WHERE p1.rel < p2.rel GROUP BY ALL HAVING count(*) >= 10)"""

_CHAIN = """, c AS (SELECT DISTINCT x.rel AS rel1, y.rel AS rel2, x.{1} AS a, y.{1} AS b FROM g x JOIN g y ON x.{0} = y.{0}), n AS (SELECT rel1, rel2, count(*) AS antecedent FROM c GROUP BY ALL)
 SELECT c.rel1, c.rel2, g.rel AS rel3, any_value(antecedent) AS antecedent, count(*) AS support FROM c JOIN g USING (a, b) JOIN n ON c.rel1 = n.rel1 AND c.rel2 = n.rel2 GROUP BY c.rel1, c.rel2, g.rel"""

_D = """d0 AS (SELECT o_custkey, count(*)::DOUBLE AS n FROM orders GROUP BY 1), d AS (SELECT o_custkey AS item, (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()) AS difficult,
 CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE 1 END::BIGINT AS detail, o_custkey % 10 AS fold FROM d0)"""

_RULE_ROWS = ", ".join(f"({rule}, '{feature}')" for rule, feature in _RULES)

SQL = {
    "r4_singles": f"WITH {_P} SELECT * FROM one",
    "r5_conjunctions": f"WITH {_P} SELECT * FROM two",
    "r5_inverses": f"WITH {_P} SELECT x.rel AS rel1, y.rel AS rel2, count(*) AS support FROM g x JOIN g y ON x.a = y.b AND x.b = y.a WHERE x.rel <= y.rel GROUP BY ALL",
    "r6_chain_subject": f"WITH {_P}" + _CHAIN.format("a", "b"),
    "r6_chain_object": f"WITH {_P}" + _CHAIN.format("b", "a"),
    "a10_metrics": f"""WITH {_P}, ways AS (SELECT rel1, rel2, support FROM two UNION ALL SELECT rel2, rel1, support FROM two) SELECT rel1, rel2, two.support, round(two.support / x.support, 6) AS confidence, round(two.support / x.support / y.support, 6) AS lift,
 round((two.support - x.support * y.support)::DOUBLE, 6) AS leverage, CASE WHEN two.support < x.support THEN round((1 - y.support) / (1 - two.support / x.support), 6) END AS conviction FROM ways AS two JOIN one x ON x.rel = rel1 JOIN one y ON y.rel = rel2""",
    "r14_screen": f"""WITH {_GRAPH}, f AS (SELECT noi, path AS feature FROM n1 UNION SELECT noi, path || '§' || value FROM n1), r(rule, feature) AS (VALUES {_RULE_ROWS}),
 y AS (SELECT 'customer/' || c_custkey AS noi, (c_mktsegment = 'BUILDING')::BIGINT AS label FROM customer), w AS (SELECT rule, count(*) AS n FROM r GROUP BY rule), v AS (SELECT noi, rule FROM f JOIN r USING (feature) JOIN w USING (rule) GROUP BY noi, rule, w.n HAVING count(*) = w.n),
 h AS (SELECT rule, coalesce(sum(label), 0)::BIGINT AS tp, coalesce(sum(1 - label), 0)::BIGINT AS fp FROM (SELECT DISTINCT rule FROM r) LEFT JOIN v USING (rule) LEFT JOIN y USING (noi) GROUP BY rule),
 q AS (SELECT *, (SELECT sum(1 - label) FROM y)::BIGINT - fp AS tn, (SELECT sum(label) FROM y)::BIGINT - tp AS fn FROM h)
 SELECT rule, tp, fp, tn, fn, round(tp / nullif(tp + fp, 0), 6) AS "precision", round(tn / nullif(tn + fp, 0), 6) AS specificity, round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM q""",
    "s11_entity": f"WITH {_GRAPH} SELECT * FROM t WHERE s = 'nation/3' UNION ALL SELECT * FROM t WHERE o = 'nation/3' AND NOT is_lit",
    "m1_delete": f"WITH {_GRAPH} SELECT p, count(*) AS n FROM t WHERE s NOT IN ('nation/3', 'customer/7') AND (is_lit OR o NOT IN ('nation/3', 'customer/7')) GROUP BY p",
    "a17_credibility": f"""WITH {_D}, b AS (SELECT CASE WHEN difficult = 0 THEN 1 ELSE (SELECT count(*) FROM range(0, 10) s(k) WHERE k / 10 < difficult) END AS bin, avg(difficult) AS m, sum(1 - detail) AS e, count(*) AS n FROM d GROUP BY 1)
 SELECT round(1 - sum((1 - m) * e / (SELECT sum(e) FROM b) * n / (SELECT sum(n) FROM b)), 6) AS cr FROM b""",
    "a19_folds": f"WITH {_D}, k AS (SELECT fold, avg(detail) AS acc, sum(1 - detail) AS err FROM d GROUP BY fold) SELECT round(avg(acc), 6) AS mean_accuracy, round(var_pop(acc), 8) AS var_accuracy, sum(err)::BIGINT AS errors FROM k",
    "b2_weights": f"""WITH {_D}, x AS (SELECT item, 1 / (1 + exp(difficult)) AS v FROM d), z AS (SELECT item, (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) AS loss FROM x)
 SELECT item, round(loss, 6) AS loss, round(loss / sum(loss) OVER (), 8) AS weight FROM z""",
}
