"""Numbers, years and bins as column expressions. Missing is always NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cadastra.functions.text import as_column, strip_ws

NUMBER = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\z"


def to_number(col: str | Column) -> Column:
    """Double of a text; anything that is not a plain number becomes NULL.

    The pattern guards against texts a cast would take (``1d``, ``NaN``); what
    does not match is extracted as the empty text, which is no number either.
    """
    return F.regexp_extract(strip_ws(col), NUMBER, 1).try_cast("double")


def footnoted_number(col: str | Column) -> Column:
    """Number with thousands commas; footnote marks such as ``..`` are no numbers."""
    return to_number(F.translate(as_column(col).cast("string"), ",", ""))


def number_of(df: DataFrame, name: str) -> Column:
    """Number from a column of any type, without a detour over text for numeric ones."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    return to_number(name)


def to_year(number: Column) -> Column:
    """Whole year of a number; the fraction is cut off."""
    return number.try_cast("int")


def null_outside(col: str | Column, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """NULL where the value is below ``low`` or above ``high`` (bounds included)."""
    col = as_column(col)
    keep = F.lit(True)
    if low is not None:
        keep = keep & (col >= low)
    if high is not None:
        keep = keep & (col <= high)
    return F.when(keep, col)


def years_between(later: str | Column, earlier: str | Column) -> Column:
    return as_column(later) - as_column(earlier)


def bin_right_closed(col: str | Column, edges: list[float], labels: list[str], missing: str = "unknown") -> Column:
    """Label of the bin ``(edge[i-1], edge[i]]``; the last label is above all edges."""
    col = as_column(col)
    out = F.when(col.isNull(), F.lit(missing))
    for edge, label in zip(edges, labels):
        out = out.when(col <= edge, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


# Bins of the year built and of the years since an improvement.
BUILT_EDGES = [1949, 1979, 1999]
BUILT_LABELS = ["pre_1950", "1950_1979", "1980_1999", "2000_plus"]
RECENCY_EDGES = [5, 15, 30]
RECENCY_LABELS = ["0_5y", "6_15y", "16_30y", "31y_plus"]


def building_age_bin(year_built: str | Column) -> Column:
    return bin_right_closed(year_built, BUILT_EDGES, BUILT_LABELS)


def improvement_recency_bin(years: str | Column) -> Column:
    return bin_right_closed(years, RECENCY_EDGES, RECENCY_LABELS)


def month_label_date(label: str | Column) -> Column:
    """First day of a ``January 1951`` label; other texts become NULL."""
    text = strip_ws(F.regexp_replace(as_column(label), " ", " "))
    return F.to_date(F.try_to_timestamp(text, F.lit("MMMM yyyy")))
