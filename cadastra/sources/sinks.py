"""Writers for tables, reports and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, replacing what is there; facts are partitioned, e.g. by year.

    The rebalance hint gathers the rows of a partition value and splits a large
    one over many tasks.
    """
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Parquet that replaces only the partitions that ``df`` has rows of; the others stay as they are."""
    writer = df.hint("rebalance", *partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path)


def write_report(df: DataFrame, path: str, note: str | None = None) -> None:
    """CSV with a header, optionally with a constant note column."""
    if note is not None:
        df = df.withColumn("note", F.lit(note))
    df.write.mode("overwrite").option("header", True).csv(path)


def write_metadata(df: DataFrame, path: str) -> None:
    """One-row table as JSON."""
    df.write.mode("overwrite").json(path)
