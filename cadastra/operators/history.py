"""Leakage-safe history of a measure per group and year.

The facts are aggregated to one row per (year, group) first; the windows then
run over those few rows per group, always ending before the current year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cadastra.functions.text import blank_to_unknown
from cadastra.operators.quantiles import stats_with_quantiles
from cadastra.session import stage


def group_year_stats(
    fact: DataFrame, year: str, group: str, target: str
) -> DataFrame:
    """Exact median, mean and count of the target per (year, group)."""
    base = fact.select(year, blank_to_unknown(group).alias(group), F.col(target).cast("double").alias(target))
    return stats_with_quantiles(
        base,
        [year, group],
        target,
        {"median": 0.5},
        [F.avg(target).alias("mean"), F.count(target).alias("count")],
    )


def history_names(prefix: str, measure: str, extended: bool) -> list[str]:
    names = [
        f"{prefix}_prev_year_median_{measure}",
        f"{prefix}_prev_year_mean_{measure}",
        f"{prefix}_prev_year_property_count",
        f"{prefix}_prev_year_growth_rate",
        f"{prefix}_prev_2yr_median_{measure}",
    ]
    if extended:
        names += [
            f"{prefix}_prev_2yr_mean_{measure}",
            f"{prefix}_prev_3yr_rolling_median_{measure}",
            f"{prefix}_prev_3yr_rolling_mean_{measure}",
            f"{prefix}_prev_3yr_growth_trend",
            f"{prefix}_prev_3yr_value_std",
        ]
    else:
        names += [f"{prefix}_prev_3yr_rolling_median_{measure}", f"{prefix}_prev_3yr_growth_trend"]
    return names


def history_columns(
    stats: DataFrame, year: str, group: str, prefix: str, measure: str, strict_year: bool = False
) -> dict[str, Column]:
    """All history columns over (year, group, median, mean, count) rows.

    By default "previous" is the previous observed year of the group. With
    ``strict_year`` it is the calendar year before, NULL when that is missing.
    """
    ordered = Window.partitionBy(group).orderBy(year)
    position = F.row_number().over(ordered)
    if strict_year:
        position = F.col(year)
        last3 = ordered.rangeBetween(-3, -1)
        back = lambda col, n: F.max(col).over(ordered.rangeBetween(-n, -n))
    else:
        last3 = ordered.rowsBetween(-3, -1)
        back = lambda col, n: F.lag(col, n).over(ordered)

    seen = F.count("median").over(last3)
    return {
        f"{prefix}_prev_year_median_{measure}": back("median", 1),
        f"{prefix}_prev_year_mean_{measure}": back("mean", 1),
        f"{prefix}_prev_year_property_count": back("count", 1),
        f"{prefix}_prev_year_growth_rate": F.try_divide(back("median", 1), back("median", 2)) - 1,
        f"{prefix}_prev_2yr_median_{measure}": back("median", 2),
        f"{prefix}_prev_2yr_mean_{measure}": back("mean", 2),
        f"{prefix}_prev_3yr_rolling_median_{measure}": F.when(
            seen >= 2, F.percentile("median", F.lit(0.5)).over(last3)
        ),
        f"{prefix}_prev_3yr_rolling_mean_{measure}": F.when(seen >= 2, F.avg("median").over(last3)),
        f"{prefix}_prev_3yr_growth_trend": F.when(
            seen == 3, F.regr_slope(F.col("median"), F.col("_position")).over(last3)
        ),
        f"{prefix}_prev_3yr_value_std": F.when(seen >= 2, F.stddev_samp("median").over(last3)),
        "_position": position,
    }


def history_of_stats(
    stats: DataFrame,
    year: str,
    group: str,
    prefix: str,
    extended: bool = False,
    keep: list[str] | None = None,
    measure: str = "land_value",
    strict_year: bool = False,
) -> DataFrame:
    columns = history_columns(stats, year, group, prefix, measure, strict_year)
    names = keep or history_names(prefix, measure, extended)
    placed = stats.withColumn("_position", columns["_position"])
    return placed.select(year, group, *[columns[n].alias(n) for n in names])


def group_history(
    fact: DataFrame,
    year: str,
    group: str,
    target: str,
    prefix: str,
    extended: bool = False,
    keep: list[str] | None = None,
    measure: str = "land_value",
    strict_year: bool = False,
) -> DataFrame:
    """History columns, one row per observed (year, group)."""
    stats = group_year_stats(fact, year, group, target)
    return history_of_stats(stats, year, group, prefix, extended, keep, measure, strict_year)


def attach_history(fact: DataFrame, history: DataFrame, year: str, group: str) -> DataFrame:
    """Left join of the history; its real size decides between broadcast and shuffle."""
    side = stage(history).withColumnsRenamed({year: "_hy", group: "_hg"})
    on = (F.col(year) == F.col("_hy")) & (F.col("_group_key") == F.col("_hg"))
    return fact.withColumn("_group_key", blank_to_unknown(group)).join(side, on, "left").drop("_hy", "_hg", "_group_key")
