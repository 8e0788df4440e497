"""The registry and the SQL fragments its entries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name; ``sql`` gives the same rows."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    cols: list[Column] = []
    for f in df.schema:
        plain = f.dataType.typeName() == "double"
        cols.append(F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if plain else F.col(f"`{f.name}`"))
    return df.select(*cols)


def sql_number(text: str) -> str:
    return (
        f"case when regexp_full_match(trim({text}), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') "
        f"then try_cast(trim({text}) as double) end"
    )


def with_sql(*parts: tuple[str, str]) -> str:
    return "with " + ",\n".join(f"{name} as ({sql})" for name, sql in parts) + "\n"
