"""What the driver's entry module registers of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievemark.plans.queries import QUERIES, SQL, file_records


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_records(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
