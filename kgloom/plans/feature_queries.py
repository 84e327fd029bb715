"""Queries of matrices with counts and levels, of label and result tables, and of small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom import sinks
from kgloom.extract import Extractor, Featurizer, update_experiment
from kgloom.functions import credibility, features, frames, matrix
from kgloom.operators import order
from kgloom.plans.graph_queries import _COUNTS, _GRAPH, _customers, _nbh
from kgloom.plans.model_queries import _doubled
from kgloom.plans.rule_queries import _D, _predicted
from kgloom.sources import seeds
from kgloom.sources.tables import business_graph


def _by_feature(cells: DataFrame) -> DataFrame:
    return cells.groupBy("feature").agg(F.count("*").alias("n"), F.sum("val").alias("total"))


def f8_fit_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the matrix with counts and levels: cells and their sum."""
    cells, _ = Featurizer(counts=True, levels=True).fit_transform(_nbh(spark, sf_dir, 1))
    return _by_feature(cells)


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    whole = _nbh(spark, sf_dir, 1)
    odd = F.substring_index("noi", "/", -1).cast("long") % 2 == 1
    return whole.where(~odd), whole.where(odd)


def f9_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with odd keys, at the levels of those with even ones."""
    train, test = _split(spark, sf_dir)
    model = Featurizer(counts=True, levels=True)
    model.fit_transform(train)
    return _by_feature(model.transform(test)[0])


def f3_represent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real values in place of path§value where a node's values are numbers."""
    return _by_feature(features.represent(features.with_counts(_nbh(spark, sf_dir, 1)), real=True))


def f5_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the sparse matrix: how many cells, the first and the last index."""
    cells = features.represent(_nbh(spark, sf_dir, 1))
    rows = matrix.sparse_rows(cells, matrix.vocabulary(cells))
    return rows.select("noi", F.size("indices").cast("long").alias("n"), F.array_min("indices").alias("low"), F.array_max("indices").alias("high"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"))


def f10_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence of paths as a column each."""
    cells = features.represent(_nbh(spark, sf_dir, 1)).where(~F.contains("feature", F.lit("§")))
    return sinks.wide(cells, ["inNation", "orderedBy"])


def g6_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of positive and negative seeds, and the rows of their neighbourhoods; a node in both is positive."""
    t = business_graph(spark, sf_dir)
    positive = [("?s", "inNation", "nation/3")]
    negative = _customers(spark, sf_dir).where("noi LIKE 'customer/%7'")
    nbh, labels = Extractor(t, [("customer/", "c:"), ("inNation", "in")]).create_dataset(spark, 1, positive, negative, ["segment", "in"])
    return labels.join(nbh.groupBy("noi").agg(F.sum("mult").alias("n_walks")), "noi", "left").select("noi", "label", "n_walks")


def p8_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("<"), "c_name", F.lit(">")).alias("noi"))
    return c.select("noi", frames.without_ends(F.col("noi")).alias("name"))


def p20_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = business_graph(spark, sf_dir).where("p IN ('inRegion', 'name')")
    return t.select(frames.formatted(F.col("o"), F.col("is_lit")).alias("node")).distinct()


def p13_recoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes to 0 and 1, signs to -1 and 1, columns renamed."""
    rows = _predicted(spark, sf_dir).withColumn("said", F.when(F.col("detail") == 0, "error").otherwise("correct"))
    out = rows.select("item", frames.outcome(F.col("said")).alias("detail"), frames.signed(F.col("item") % 3).alias("label"))
    return frames.renamed(out.withColumn("old", F.lit(1)), {"label": "sign", "nowhere": "x"}, ["old"])


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    hole = lambda c, k: F.when(F.col(c) % k != 0, F.col(c))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", hole("o_custkey", 5).alias("o_custkey"), hole("o_orderkey", 4).cast("double").alias("x"))


def p15_imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.imputed(_gaps(spark, sf_dir))


def p19_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.missing_values(_gaps(spark, sf_dir))


def p16_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes fitted on even customers, put on odd ones."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_mktsegment").alias("label"))
    return matrix.LabelCodes(c.where("c_custkey % 2 = 0")).transform(c.where("c_custkey % 2 = 1"))


def j3_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers with their difficulty, null where they have none."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("item"), F.lit(0).alias("difficult"))
    hard = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("item")).agg(F.count("*").alias("difficult"))
    return frames.with_difficulty(c, hard)


def j2_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = features.binary(_nbh(spark, sf_dir, 1)).groupBy("noi").agg(F.count("*").alias("n"))
    labels = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal > 0").select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("item"), F.col("c_mktsegment").alias("label"))
    return frames.with_labels(cells, labels)


def w4_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"))
    return frames.holdout(c, "id", 3, 4)


def w13_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's first order."""
    return frames.first_of_each(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


def w12_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where shares of the cumulated orders fall."""
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("item")).agg(F.count("*").alias("n"))
    shares = spark.createDataFrame([(k / 16,) for k in range(17)], "share double")
    return order.first_place(n, "n", shares, "item")


def a14_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.duplicates(_doubled(spark, sf_dir), "item", "sign")


def a18_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credibility.credibility_by_value(_predicted(spark, sf_dir)).select(F.round("cr", 6).alias("cr"))


def a21_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.sample_variance(_predicted(spark, sf_dir), "difficult").select(F.round("variance", 8).alias("variance"))


def a25_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.classes(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_mktsegment")


def a30_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credibility.running_errors(_predicted(spark, sf_dir).withColumn("loss", F.col("difficult") * 2))
    return found.select("fold", "errors", F.round("error_loss", 6).alias("error_loss"))


def a26_mean_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = features.represent(_nbh(spark, sf_dir, 1))
    two = one.where(~F.startswith("feature", F.lit("inNation§nation/3")))
    return matrix.mean_cosine(one, two).select(F.round("cosine", 6).alias("cosine"))


def u1_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    return seeds.union(c.where("noi LIKE '%1'"), c.where("noi LIKE '%11'"), c.where("noi LIKE '%2'"))


def m7_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three customers go and come back one by one: nothing differs."""
    nodes = _customers(spark, sf_dir).where("noi LIKE '%7'")
    got = update_experiment(Extractor(business_graph(spark, sf_dir)), nodes, 1, 3, ["segment"], counts=True)
    return spark.createDataFrame([(round(got["cosine"], 9), got["cells"], got["columns"])], "cosine double, cells long, columns long")


QUERIES = {f.__name__: f for f in (f8_fit_transform, f9_transform, f3_represent, f5_sparse, f10_wide, g6_dataset, p8_names, p20_formatted, p13_recoded, p15_imputed, p19_missing, p16_transform, j3_difficulty, j2_labelled, w4_holdout, w13_first, w12_places, a14_duplicates, a18_by_value, a21_variance, a25_classes, a30_running, a26_mean_cosine, u1_union, m7_update)}


def _matrix(rows: str, of: str = "true", levels_of: str = "true") -> str:
    """CTEs of a matrix with counts and levels over the depth-1 rows that fit a condition, levels from others."""
    return f"""{_GRAPH}, c AS ({_COUNTS.format('n1')}), w AS (SELECT noi, path, value FROM n1 UNION ALL SELECT noi, path, value FROM c), own AS (SELECT * FROM w WHERE {of}),
 x AS (SELECT path, value, try_cast(value AS DOUBLE) AS x FROM w WHERE {levels_of}), able AS (SELECT path FROM x GROUP BY path HAVING count(*) = count(x)),
 s AS (SELECT DISTINCT path, value AS level, x AS l FROM x WHERE path IN (SELECT path FROM able)),
 e AS (SELECT noi, path, min(try_cast(value AS DOUBLE)) AS low, max(try_cast(value AS DOUBLE)) AS high FROM own WHERE path IN (SELECT path FROM able) GROUP BY noi, path),
 cells AS (SELECT DISTINCT noi, path AS feature, 1.0::DOUBLE AS val FROM own UNION SELECT DISTINCT noi, path || '§' || value, 1.0 FROM own
  UNION ALL SELECT noi, path || '<=' || level, (low <= l)::INT FROM e JOIN s USING (path) UNION ALL SELECT noi, path || '>=' || level, (high >= l)::INT FROM e JOIN s USING (path)) {rows}"""


_ODD = "regexp_extract(noi, '[0-9]+$')::INT % 2 = "
_SUM = "SELECT feature, count(*) AS n, sum(val) AS total FROM cells GROUP BY feature"
_CELLS1 = "SELECT DISTINCT noi, path AS feature FROM n1 UNION SELECT noi, path || '§' || value FROM n1"
SQL = {
    "f8_fit_transform": "WITH " + _matrix(_SUM).replace("\n e AS", "\n ends AS").replace("FROM e JOIN", "FROM ends JOIN"),
    "f9_transform": "WITH " + _matrix(_SUM, _ODD + "1", _ODD + "0").replace("\n e AS", "\n ends AS").replace("FROM e JOIN", "FROM ends JOIN"),
    "f3_represent": f"""WITH {_GRAPH}, c AS ({_COUNTS.format('n1')}), w AS (SELECT noi, path, value FROM n1 UNION ALL SELECT noi, path, value FROM c),
 x AS (SELECT noi, path, count(*) = count(try_cast(value AS DOUBLE)) AS able, max(try_cast(value AS DOUBLE)) AS v FROM w GROUP BY noi, path),
 cells AS (SELECT noi, path AS feature, 1.0::DOUBLE AS val FROM x UNION ALL SELECT noi, path || '_real_data', v FROM x WHERE able UNION ALL SELECT DISTINCT noi, path || '§' || value, 1.0 FROM w JOIN x USING (noi, path) WHERE NOT able) {_SUM}""",
    "f5_sparse": f"""WITH {_GRAPH}, f AS ({_CELLS1}), k AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS i FROM (SELECT DISTINCT feature FROM f))
 SELECT noi, count(*) AS n, min(i) AS low, max(i) AS high, count(*)::DOUBLE AS total FROM f JOIN k USING (feature) GROUP BY noi""",
    "f10_wide": f"WITH {_GRAPH} SELECT noi, max((path = 'inNation')::INT)::DOUBLE AS \"inNation\", max((path = 'orderedBy')::INT)::DOUBLE AS \"orderedBy\" FROM n1 GROUP BY noi",
    "g6_dataset": """SELECT 'customer/' || c_custkey AS noi, (c_nationkey = 3)::INT AS label, nullif((SELECT count(*) FROM orders WHERE o_custkey = c_custkey), 0) AS n_walks FROM customer WHERE c_nationkey = 3 OR c_custkey % 10 = 7
 UNION ALL SELECT 'supplier/' || s_suppkey, 1, NULL FROM supplier WHERE s_nationkey = 3""",
    "p8_names": "SELECT '<' || c_name || '>' AS noi, c_name AS name FROM customer",
    "p20_formatted": f"WITH {_GRAPH} SELECT DISTINCT CASE WHEN is_lit THEN '\"' || o || '\"' ELSE '<' || o || '>' END AS node FROM t WHERE p IN ('inRegion', 'name')",
    "p13_recoded": f"WITH {_D} SELECT item, detail::INT AS detail, CASE WHEN item % 3 = 0 THEN -1 ELSE 1 END AS sign FROM d",
    "p15_imputed": "SELECT o_orderkey, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey ELSE 0 END AS o_custkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey::DOUBLE ELSE 0 END AS x FROM orders",
    "p19_missing": """SELECT 'o_custkey' AS "column", count(*) AS missing FROM orders WHERE o_custkey % 5 = 0 HAVING count(*) > 0 UNION ALL SELECT 'x', count(*) FROM orders WHERE o_orderkey % 4 = 0 HAVING count(*) > 0""",
    "p16_transform": "WITH k AS (SELECT c_mktsegment AS label, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_custkey % 2 = 0)) SELECT c_custkey, c_mktsegment AS label, code FROM customer JOIN k ON label = c_mktsegment WHERE c_custkey % 2 = 1",
    "j3_difficulty": "SELECT c_custkey AS item, n AS difficult FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON o_custkey = c_custkey",
    "j2_labelled": f"WITH {_GRAPH}, f AS ({_CELLS1}) SELECT noi, count(*) AS n, any_value(c_mktsegment) AS label FROM f JOIN customer ON noi = 'customer/' || c_custkey WHERE c_acctbal > 0 GROUP BY noi",
    "w4_holdout": "SELECT c_custkey AS id, c_custkey % 3 = 0 AS held, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey // 3 % 4 END AS part FROM customer",
    "w13_first": "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey",
    "w12_places": """WITH d AS (SELECT o_custkey AS item, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT row_number() OVER (ORDER BY item) AS pos, (sum(n) OVER (ORDER BY item))::DOUBLE / sum(n) OVER () AS share FROM d)
 SELECT k / 16 AS share, (SELECT min(pos) FROM c WHERE c.share >= k / 16) AS pos FROM range(17) t(k)""",
    "a14_duplicates": f"WITH {_D} SELECT item, item % 2 AS sign, item % 4 + 1 AS n FROM d WHERE item % 4 > 0",
    "a18_by_value": f"WITH {_D}, b AS (SELECT difficult, 1 - avg(detail) AS e, count(*) AS n FROM d GROUP BY difficult) SELECT round(1 - sum((1 - difficult) * e * n / (SELECT count(*) FROM d)), 6) AS cr FROM b",
    "a21_variance": f"WITH {_D} SELECT round(var_samp(difficult), 8) AS variance FROM d",
    "a25_classes": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1",
    "a30_running": f"""WITH {_D}, f AS (SELECT fold, sum(1 - detail)::BIGINT AS err, coalesce(avg(difficult * 2) FILTER (detail = 0), 0) AS m FROM d GROUP BY fold)
 SELECT fold, (sum(err) OVER (ORDER BY fold))::BIGINT AS errors, round(sum(m) OVER (ORDER BY fold), 6) AS error_loss FROM f""",
    "a26_mean_cosine": f"""WITH {_GRAPH}, f AS ({_CELLS1}), r AS (SELECT noi, count(*) AS n, count(*) FILTER (feature NOT LIKE 'inNation§nation/3%') AS m FROM f GROUP BY noi) SELECT round(avg(sqrt(m / n)), 6) AS cosine FROM r""",
    "u1_union": "SELECT 'customer/' || c_custkey AS noi FROM customer WHERE c_custkey % 10 IN (1, 2)",
    "m7_update": "SELECT 1.0::DOUBLE AS cosine, 0::BIGINT AS cells, 0::BIGINT AS columns",
}
