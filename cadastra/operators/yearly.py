"""Yearly series: shaping, lags and the left join onto facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from cadastra.functions.numbers import number_of, to_year
from cadastra.operators.checks import usable_numeric_columns
from cadastra.session import stage


def yearly_from_monthly(long: DataFrame, date: str, value: str, average: str, last: str, year: str) -> DataFrame:
    """Yearly mean and last value of a dated series, in one aggregate."""
    rows = long.where(F.col(date).isNotNull() & F.col(value).isNotNull())
    return rows.groupBy(F.year(date).alias(year)).agg(
        F.avg(value).alias(average), F.max_by(value, date).alias(last)
    )


def yearly_passthrough(df: DataFrame, year_from: str, year: str, mapping: dict[str, str]) -> DataFrame:
    """Renamed numeric columns of a table that already has a year."""
    out = df.select(
        to_year(number_of(df, year_from)).alias(year),
        *[number_of(df, source).alias(name) for source, name in mapping.items()],
    )
    return out.where(F.col(year).isNotNull())


def last_per_year(df: DataFrame, year: str, cols: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per year: the last in the given order (default: by the values)."""
    last = F.max_by(F.struct(*cols), F.struct(*(order or cols))).alias("_row")
    return df.groupBy(year).agg(last).select(year, *[F.col("_row")[c].alias(c) for c in cols])


def with_lags(df: DataFrame, year: str, cols: list[str]) -> DataFrame:
    """``_lag1`` and ``_yoy_change`` of each column, by row order of the years.

    The window has no partition, which is fine for one row per year only.
    """
    ordered = Window.orderBy(year)
    out = {}
    for c in cols:
        out[f"{c}_lag1"] = F.lag(c).over(ordered)
        out[f"{c}_yoy_change"] = F.col(c) - F.lag(c).over(ordered)
    return df.withColumns(out)


def with_years_until(df: DataFrame, year: str, last_year: int) -> DataFrame:
    """Empty rows for the years after the last one, so that lags reach them."""
    end = F.max(year).alias("_end")
    missing = F.when(F.col("_end") < last_year, F.sequence(F.col("_end") + 1, F.lit(last_year)))
    spine = df.agg(end).select(F.explode(missing).alias(year))
    return df.unionByName(spine, allowMissingColumns=True)


def prepare_yearly(
    df: DataFrame | None, year: str, order: list[str] | None = None, extend_to: int | None = None
) -> tuple[DataFrame | None, str]:
    """A series ready to join, and its status; a source that is no use gives None.

    By default a series ends with its last year; ``extend_to`` adds later years,
    which then hold the lag of the year before.
    """
    if df is None:
        return None, "missing_input"
    if year not in df.columns:
        return None, f"missing_{year}"
    cols = [c for c in df.columns if c != year]
    keyed = df.select(
        to_year(number_of(df, year)).alias(year),
        *[number_of(df, c).alias(c) for c in cols],
        *[F.col(c).alias(f"_order_{c}") for c in order or []],
    ).where(F.col(year).isNotNull())
    usable = usable_numeric_columns(keyed, cols)
    if not usable:
        return None, "no_numeric_features"
    single = last_per_year(keyed, year, usable, [f"_order_{c}" for c in order] if order else None)
    if extend_to is not None:
        single = with_years_until(single, year, extend_to)
    return with_lags(single, year, usable), "merged"


def merge_yearly(
    fact: DataFrame, sources: dict[str, DataFrame | None], year: str
) -> tuple[DataFrame, list[str], dict[str, str]]:
    """Facts with the columns of all usable series, the columns, and a status per source.

    The series are first joined to each other by year, so the facts meet one
    small table and are read once.
    """
    tables, statuses = [], {}
    for name, df in sources.items():
        table, statuses[name] = prepare_yearly(df, year)
        if table is not None:
            tables.append(table)
    if not tables:
        return fact, [], statuses
    macro = stage(reduce(lambda a, b: a.join(b, year, "full"), tables))
    cols = [c for c in macro.columns if c != year]
    return fact.join(macro, year, "left"), sorted(cols), statuses
