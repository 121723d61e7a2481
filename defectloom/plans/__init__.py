"""Queries over the graded tables and their SQL; importing the package registers them."""

from defectloom.plans import analysis, history, models, predicates, registry, risk, stored, streaming


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    return dict(registry.ORACLE_SQL)


__all__ = ["analysis", "history", "models", "oracle_sql", "predicates", "queries", "risk", "stored", "streaming"]
