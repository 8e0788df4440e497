"""History kept up to date: a stored state per year that new facts are merged into.

The state is how often each value occurs per (year, group). A batch of facts is
counted, merged with the stored counts of its own years only, and only those
years' partitions are written again; the statistics of a year follow from its
counts. So a new year costs one pass over its facts, and late facts of an old
year one pass over them and that year's counts. The windows of the history run
over one row per year and group, as ever.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cadastra.functions.text import blank_to_unknown
from cadastra.operators.history import history_of_stats
from cadastra.operators.quantiles import exact_quantiles
from cadastra.session import stage
from cadastra.sources.delimited import path_exists
from cadastra.sources.sinks import write_partitions

COUNTS = "group string, value double, n long, year int"
STATS = "group string, median double, mean double, count long, year int"


def group_value_counts(fact: DataFrame, year: str, group: str, target: str) -> DataFrame:
    """``COUNTS``: facts per year, group and value; a group of NULL targets keeps one row without a value."""
    rows = fact.select(blank_to_unknown(group).alias("group"), F.col(target).cast("double").alias("value"), F.col(year).cast("int").alias("year"))
    return rows.where(F.col("year").isNotNull()).groupBy("year", "group", "value").agg(F.count(F.lit(1)).alias("n")).select("group", "value", "n", "year")


def stats_of_counts(counts: DataFrame) -> DataFrame:
    """``STATS``: exact median, mean and count of each year and group."""
    valued = F.col("value").isNotNull()
    plain = counts.groupBy("year", "group").agg(
        F.try_divide(F.sum(F.col("value") * F.col("n")), F.sum(F.when(valued, F.col("n")))).alias("mean"),
        F.coalesce(F.sum(F.when(valued, F.col("n"))), F.lit(0)).alias("count"),
    )
    medians = exact_quantiles(counts, ["year", "group"], "value", {"median": 0.5}, weight="n")
    return plain.join(medians, ["year", "group"], "left").select("group", "median", "mean", "count", "year")


def add_facts(spark: SparkSession, fact: DataFrame, path: str, year: str, group: str, target: str) -> list[int]:
    """Merge facts into the state at ``path``; returns the years that were written again.

    Facts are added to what is there: to run a batch a second time adds it twice.
    """
    new = stage(group_value_counts(fact, year, group, target))
    years = sorted(r[0] for r in new.select("year").distinct().collect())  # one number a year
    if path_exists(spark, f"{path}/counts"):
        old = spark.read.schema(COUNTS).parquet(f"{path}/counts").where(F.col("year").isin(years))
        new = old.unionByName(new).groupBy("year", "group", "value").agg(F.sum("n").alias("n")).select("group", "value", "n", "year")
        new = stage(new)  # read before its own partitions are replaced
    write_partitions(new, f"{path}/counts", ["year"])
    write_partitions(stats_of_counts(new), f"{path}/stats", ["year"])
    return years


def stored_history(
    spark: SparkSession, path: str, year: str, group: str, prefix: str, extended: bool = False, keep: list[str] | None = None, measure: str = "land_value", strict_year: bool = False
) -> DataFrame:
    """The history columns of ``history.group_history``, from the stored statistics."""
    stats = spark.read.schema(STATS).parquet(f"{path}/stats").withColumnsRenamed({"year": year, "group": group})
    return history_of_stats(stats, year, group, prefix, extended, keep, measure, strict_year)
