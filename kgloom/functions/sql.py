"""What SQL may call: table functions that parse documents, and scalar functions of the rule sets' score."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kgloom.sources import rdf


class _Parse:
    """A document's triples, a row each; a null one has none."""

    parser = staticmethod(rdf.parse_turtle)

    def eval(self, text: str, mark: str):
        for row in self.parser(text, mark or "") if text is not None else ():
            yield row


class _ParseXml(_Parse):
    parser = staticmethod(rdf.parse_rdfxml)


def _log_betabin(k: pd.Series, n: pd.Series, alpha: pd.Series, beta: pd.Series) -> pd.Series:
    """The logarithm of the beta-binomial weight of k out of n, without the coefficient."""
    from kgloom.mining.ruleset import _lbb

    return pd.Series([float(_lbb(*x)) for x in zip(k, n, alpha, beta, strict=True)], dtype=float)


def register(spark: SparkSession) -> None:
    """Registers parse_turtle(text, mark) and parse_rdfxml(text, mark) as table functions, log_betabin(k, n, alpha, beta) and is_number(text) as functions."""
    spark.udtf.register("parse_turtle", F.udtf(_Parse, returnType=rdf.SCHEMA))
    spark.udtf.register("parse_rdfxml", F.udtf(_ParseXml, returnType=rdf.SCHEMA))
    spark.udf.register("log_betabin", F.pandas_udf(_log_betabin, "double"))
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION is_number(text STRING) RETURNS BOOLEAN RETURN text IS NOT NULL AND text RLIKE '(?i)^\\s*[+-]?((\\d+\\.?\\d*|\\.\\d+)(e[+-]?\\d+)?|inf|infinity|nan)\\s*$'")
