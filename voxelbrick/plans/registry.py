"""Names, jobs and their SQL. A job module lists its own in QUERIES: name -> (callable, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxelbrick.plans import files, tables, volumes

MODULES = (volumes, tables, files)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volumes.a4_report(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
