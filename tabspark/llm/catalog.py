"""The registry of this subpackage's queries."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def let_workers_import(spark: SparkSession) -> None:
    """Python workers of this session find the package where the driver found it, wherever they start."""
    known = spark.sparkContext.environment
    paths = known.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        known["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        @functools.wraps(run)
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            let_workers_import(spark)
            return run(spark, sf_dir)

        QUERIES[name] = prepared
        if sql is not None:
            SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
