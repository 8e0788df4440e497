"""Delimited text scans: every column is read as text and cast later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cadastra.operators.checks import require_columns


def read_text_table(
    spark: SparkSession, path: str | list[str], sep: str = ",", encoding: str = "UTF-8", multi_line: bool = False
) -> DataFrame:
    """All columns as text under their header names; types are never inferred."""
    return (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("multiLine", multi_line)
        .option("inferSchema", False)
        .csv(path)
    )


def read_columns(
    spark: SparkSession,
    path: str | list[str],
    required: list[str],
    optional: list[str] | None = None,
    sep: str = ",",
    encoding: str = "UTF-8",
    what: str = "table",
) -> DataFrame:
    """Required and optional text columns; an absent optional column is all NULL."""
    raw = require_columns(read_text_table(spark, path, sep, encoding), required, what)
    return raw.select(*required, *[optional_column(raw, c) for c in optional or []])


def optional_column(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind).alias(name)


def read_optional_table(spark: SparkSession, path: str | None, schema: str | T.StructType) -> DataFrame:
    """A report written earlier, or an empty table with its schema."""
    if path is None or not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv(path)


def read_optional_json(spark: SparkSession, path: str | None, schema: str | T.StructType) -> DataFrame:
    if path is None or not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there on whatever file system it names."""
    try:
        spark.read.format("binaryFile").load(path).schema
        return True
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise


def default_year(metadata: DataFrame, lookup: DataFrame, year: str) -> Column:
    """The metadata's default year, else the last year of the lookup table."""
    known = metadata.agg(F.max("default_report_year").cast("int").alias("y")).scalar()
    return F.coalesce(known, lookup.agg(F.max(year).cast("int").alias("y")).scalar())
