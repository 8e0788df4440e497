"""Target transform and error columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cadastra.functions.text import as_column


def log_target(col: str | Column) -> Column:
    return F.log1p(as_column(col))


def unlog_prediction(col: str | Column) -> Column:
    """Back from the log scale, never below zero."""
    return F.greatest(F.expm1(as_column(col)), F.lit(0.0))


def abs_error(truth: str | Column, pred: str | Column) -> Column:
    return F.abs(as_column(pred) - as_column(truth))


def sq_error(truth: str | Column, pred: str | Column) -> Column:
    gap = as_column(pred) - as_column(truth)
    return gap * gap


def ape(truth: str | Column, pred: str | Column) -> Column:
    """Absolute error relative to the truth; NULL unless the truth is positive."""
    return F.when(as_column(truth) > 0, abs_error(truth, pred) / as_column(truth))


def capped(col: str | Column, cap: Column | float) -> Column:
    return F.least(as_column(col), cap if isinstance(cap, Column) else F.lit(float(cap)))
