"""All registered queries of the core, and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brookmill.plans import data_queries, output_queries, prepare_queries, score_queries
from brookmill.plans.score_queries import cls_report  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**score_queries.QUERIES, **prepare_queries.QUERIES, **data_queries.QUERIES, **output_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**score_queries.SQL, **prepare_queries.SQL, **data_queries.SQL, **output_queries.SQL}
