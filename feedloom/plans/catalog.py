"""All registered queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedloom.plans import io_queries, reports, rule_queries, table_queries, views
from feedloom.plans.model import model

MODULES = (reports, views, rule_queries, table_queries, io_queries)


def _bind(build) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, path: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return build(model(spark, path))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bind(build) for module in MODULES for name, (build, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql is not None}
