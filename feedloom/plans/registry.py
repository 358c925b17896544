"""All registered queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "dashboard_trends"


def query(name: str, sql: str | None = None):
    """Registers ``f(v)`` over the views of a table folder; ``sql`` is DuckDB's equivalent, which
    may name the views."""
    from feedloom.plans.views import Views, oracle

    def add(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLE[name] = oracle(sql)
        return f

    return add


def _load() -> None:
    from feedloom.plans import cluster_queries, dashboard_queries, intake_queries, response_queries, routing_queries, stream_queries, text_queries, ticket_queries, trend_queries  # noqa: F401


_load()
