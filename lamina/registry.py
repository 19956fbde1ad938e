"""Registered queries, each with its SQL in the other engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, views: str, run: Callable[..., DataFrame], sql: str | None, rounded: str = "") -> None:
    """Registers a query over views; the columns named in `rounded` are rounded to 6 places (SQL rounds its own)."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = run(*[view(spark, sf_dir, v) for v in views.split()])
        return out.withColumns({c: F.round(c, 6) for c in rounded.split()})

    QUERIES[name] = query
    if sql:
        SQL[name] = with_views(sql)
