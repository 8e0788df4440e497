"""Counts, modes, null rates and long summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

SUMMARY = "section string, metric string, value string"


def value_counts(df: DataFrame, col: str, count: str = "count") -> DataFrame:
    """Rows per value; NULL counts as a value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(count))


def top_values(df: DataFrame, col: str, k: int, count: str = "count") -> DataFrame:
    """The k most frequent values, ties by the smaller value."""
    return value_counts(df, col, count).orderBy(F.desc(count), F.asc(col)).limit(k)


def top_options(df: DataFrame, col: str, k: int, count: str = "count") -> DataFrame:
    """The k most frequent non-null values as trimmed texts."""
    text = F.trim(F.col(col).cast("string"))
    return top_values(df.where(F.col(col).isNotNull()).select(text.alias(col)), col, k, count)


def top_values_per_group(df: DataFrame, group: list[str], col: str, k: int, count: str = "count") -> DataFrame:
    counted = df.groupBy(*group, col).agg(F.count(F.lit(1)).alias(count))
    order = Window.partitionBy(*group).orderBy(F.desc(count), F.asc(col))
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def null_rates(df: DataFrame, cols: list[str], digits: int | None = None) -> DataFrame:
    """``metric, value`` with the share of NULLs per column, in one pass."""
    rate = [F.avg(F.col(c).isNull().cast("double")) for c in cols]
    if digits is not None:
        rate = [F.round(r, digits) for r in rate]
    wide = df.agg(*[r.alias(c) for r, c in zip(rate, cols)])
    return wide.unpivot([], cols, "metric", "value")


def melt(df: DataFrame, keep: list[str], cols: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """One row per (row, column) of a list of like-typed columns."""
    return df.select(*keep, *cols).unpivot(keep, cols, name, value)


def most_frequent(df: DataFrame, keys: list[str], value: str, out: str = "mode") -> DataFrame:
    """Most frequent non-null value per group; ties give the smallest value.

    Counted per (group, value) first, so no task holds all values of a group.
    """
    counted = (
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((-F.count(F.lit(1))).alias("_less"))
    )
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct("_less", value)).alias(out))


def distinct_count(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[F.count_distinct(c).alias(c) for c in cols])


def year_bounds(df: DataFrame, year: str) -> DataFrame:
    return df.agg(F.min(year).cast("int").alias("min_year"), F.max(year).cast("int").alias("max_year"))


def share_of_total(df: DataFrame, group: str, value: str, total: str, share: str) -> DataFrame:
    """Sum per group and its share of the grand total."""
    summed = df.groupBy(group).agg(F.sum(value).alias(total))
    grand = F.sum(total).over(Window.partitionBy())  # over one row for each group
    return summed.withColumn(share, F.when(grand > 0, F.try_divide(F.col(total), grand)))


def summary_rows(df: DataFrame, section: str | Column, metric: str | Column, value: Column) -> DataFrame:
    """``section, metric, value`` rows, all as text."""
    section = F.lit(section) if isinstance(section, str) else section
    metric = F.col(metric) if isinstance(metric, str) else metric
    return df.select(
        section.cast("string").alias("section"), metric.cast("string").alias("metric"), value.cast("string").alias("value")
    )


def wide_to_summary(df: DataFrame, section: str) -> DataFrame:
    """Every column of a one-row table as a summary row."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    return summary_rows(text.unpivot([], df.columns, "metric", "value"), section, "metric", F.col("value"))


def literal_summary(df: DataFrame, rows: list[tuple[str, str, object]]) -> DataFrame:
    """Summary rows known from schemas and statuses, without a job."""
    text = [(s, m, str(v)) for s, m, v in rows]
    return df.sparkSession.createDataFrame(text, SUMMARY)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def feature_columns(df: DataFrame, exclude: set[str]) -> list[str]:
    cols = [c for c in df.columns if c not in exclude]
    if not cols:
        raise ValueError("no usable feature columns after exclusions")
    return cols


def column_kinds(df: DataFrame) -> tuple[list[str], list[str]]:
    """(categorical, numeric) column names."""
    numeric = numeric_columns(df)
    return [c for c in df.columns if c not in numeric], numeric
