"""A wide monthly CSV: a preamble, a header found by its content, one row per geography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cadastra.functions.numbers import month_label_date, to_number
from cadastra.functions.text import strip_ws
from cadastra.operators.checks import require_rows

OUTSIDE_QUOTES = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'

# What marks the header line.
HEADER_MARKS = ['"Geography"', "195"]


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, at, line``; ``at`` orders the lines of a file, however it is split."""
    lines = spark.read.text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
        ).alias("at"),
        F.col("value").alias("line"),
    )


def split_quoted(line: str | Column) -> Column:
    """Fields of a CSV line, unquoted."""
    return F.transform(
        F.split(line, OUTSIDE_QUOTES, -1),
        lambda x: F.regexp_replace(F.regexp_replace(strip_ws(x), '^"|"$', ""), '""', '"'),
    )


def monthly_rows(lines: DataFrame, geography: str, marks: list[str] = HEADER_MARKS) -> DataFrame:
    """``file, month_label, value`` of the first row of a geography after the header."""
    is_header = F.lit(True)
    for mark in marks:
        is_header = is_header & F.col("line").contains(mark)
    header = (
        lines.where(is_header)
        .groupBy("file")
        .agg(F.min("at").alias("header_at"), F.min_by("line", "at").alias("header"))
    )
    # The fields are parted only where the line has the name at all.
    named = F.col("line").contains(geography.replace('"', '""'))
    rows = lines.where(F.when(named, F.get(split_quoted("line"), 0).eqNullSafe(geography)).otherwise(F.lit(False)))
    body = (
        rows.join(header, "file")
        .where(F.col("at") > F.col("header_at"))
        .groupBy("file")
        .agg(F.min_by("line", "at").alias("line"), F.first("header").alias("header"))
    )
    pairs = F.zip_with(
        split_quoted("header"), split_quoted("line"), lambda m, v: F.struct(m.alias("month_label"), v.alias("value"))
    )
    out = body.select("file", F.posexplode(pairs).alias("at", "pair")).where(F.col("at") > 0)
    return out.select("file", "pair.month_label", "pair.value")


def melt_months(wide: DataFrame, ids: list[str]) -> DataFrame:
    """Wide months to ``month_label, value`` rows, for tables read with a plain header."""
    return wide.unpivot(ids, [c for c in wide.columns if c not in ids], "month_label", "value")


def dated_values(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``date, value`` rows; other labels and values drop out."""
    out = rows.select(*keep, month_label_date("month_label").alias("date"), to_number("value").alias("value"))
    return out.where(F.col("date").isNotNull() & F.col("value").isNotNull())


def read_monthly(spark: SparkSession, path: str | list[str], geography: str = "Canada") -> DataFrame:
    lines = read_lines(spark, path)
    is_header = F.lit(True)
    for mark in HEADER_MARKS:
        is_header = is_header & F.col("line").contains(mark)
    require_rows(lines.where(is_header), "no header line with geography and months found")
    rows = require_rows(monthly_rows(lines, geography), f"no row for {geography!r} found")
    return dated_values(rows, ["file"])
