"""What the modules of queries of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadastra.session import stage

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` gives the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["ORACLES", "QUERIES", "query", "stage", "table"]
