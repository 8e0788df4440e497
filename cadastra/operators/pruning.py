"""Reads of a partitioned table that other rows decide on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def rows_of_asked_years(table: DataFrame, year: str, requests: DataFrame, asked_year: Column) -> DataFrame:
    """The rows of ``table`` whose year some request asks for.

    Where the table is partitioned by its year, Spark finds the asked years
    first and lists only their folders (dynamic partition pruning); for a table
    that isn't, this is a semi-join. Requests without a year ask for none.
    """
    wanted = requests.select(asked_year.cast("int").alias("_asked")).where(F.col("_asked") >= 0).distinct()
    return table.join(wanted, F.col(year) == F.col("_asked"), "left_semi")
