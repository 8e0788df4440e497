"""Quantiles from mergeable sketches, where an error of rank is allowed.

A KLL sketch of a group is built in one pass without a sort, and sketches of
groups merge into those of a year and of everything, so the rows are read once
for all levels. Its rank error is bounded by ``k``; a group of no more than ``k``
values is exact. ``quantiles.exact_quantiles`` stays the default elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

K = 400
#: Fixed value: for ``k``, the error of a rank as a share of the values is below about this divided by k ** 0.9 (with 99 %).
ERROR_FACTOR = 2.446


def rank_error(k: int = K) -> float:
    """Share of the values by which a quantile's rank may be off."""
    return ERROR_FACTOR / k**0.9


def group_sketches(df: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """One sketch for each group of ``keys``; NULL values are ignored, a group of only those has none."""
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    return rows.groupBy(*keys).agg(F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """The sketches of coarser ``keys`` (none for all) from finer ones; tasks merge before anything is shuffled."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Number of values and the quantiles ``{name: p}`` of each sketch: values that occur, not interpolated."""
    found = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in probs.items()]
    return sketches.select(*keys, F.kll_sketch_get_n_double("sketch").alias("n"), *found)


def with_rank_errors(quantiles: DataFrame, df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """How far each quantile's exact rank is from its share: ``<name>_error``, 0 where equal values reach over it."""
    shown = quantiles.withColumnsRenamed({k: f"_q_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_q_{k}")) for k in keys] or [F.lit(True)]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    counts = []
    for name in probs:
        counts += [F.count_if(F.col("_v") < F.col(name)).alias(f"_below_{name}"), F.count_if(F.col("_v") <= F.col(name)).alias(f"_upto_{name}")]
    ranked = rows.join(shown, condition).groupBy(*keys, "n", *probs).agg(*counts)
    errors = {f"{name}_error": F.greatest(F.lit(0.0), F.col(f"_below_{name}") / F.col("n") - p, p - F.col(f"_upto_{name}") / F.col("n")) for name, p in probs.items()}
    return ranked.withColumns(errors).select(*keys, "n", *probs, *errors)
