"""All registered queries of the reference's operators, each with the SQL it is checked against."""

from __future__ import annotations

QUERY_MODULES: tuple[str, ...] = ("graph_queries", "rule_queries", "model_queries", "feature_queries", "mining_queries", "learning_queries")


def _modules() -> list:
    import importlib

    return [importlib.import_module(f"kgloom.plans.{name}") for name in QUERY_MODULES]


def queries() -> dict:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}
