"""Error reports of scored rows, and the tables behind the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cadastra.functions.errors import abs_error, ape, capped, sq_error
from cadastra.operators.quantiles import exact_quantiles, stats_with_quantiles
from cadastra.operators.sampling import hash_sample

CAP_LEVEL = 0.995
SANITY_LEVELS = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def target_cap(train: DataFrame, target: str) -> float:
    """Exact 99.5 % quantile of the train target: one number."""
    return exact_quantiles(train, [], target, {"cap": CAP_LEVEL}).first()["cap"]


def with_errors(scored: DataFrame, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    return scored.withColumns(
        {"abs_error": abs_error(truth, pred), "sq_error": sq_error(truth, pred), "ape": ape(truth, pred)}
    )


def regression_metrics(
    scored: DataFrame, cap: float, truth: str = "y_true", pred: str = "y_pred"
) -> DataFrame:
    """One row: RMSE, MAE, median relative error and the capped twins."""
    top_truth, top_pred = capped(truth, cap), capped(pred, cap)
    return stats_with_quantiles(
        with_errors(scored, truth, pred),
        [],
        "ape",
        {"median_ape": 0.5},
        [
            F.sqrt(F.avg("sq_error")).alias("rmse"),
            F.avg("abs_error").alias("mae"),
            F.lit(cap).alias("robust_cap_p99_5"),
            F.sqrt(F.avg(sq_error(top_truth, top_pred))).alias("robust_rmse"),
            F.avg(abs_error(top_truth, top_pred)).alias("robust_mae"),
        ],
    )


def sanity_stats(
    scored: DataFrame, truth: str = "y_true", pred: str = "y_pred"
) -> DataFrame:
    """p50, p90, p99 and max of truth and prediction, one row each."""
    sides = scored.select(
        F.explode(
            F.array(
                F.struct(F.lit("y_true").alias("side"), F.col(truth).cast("double").alias("v")),
                F.struct(F.lit("y_pred").alias("side"), F.col(pred).cast("double").alias("v")),
            )
        ).alias("s")
    ).select("s.side", "s.v")
    return stats_with_quantiles(sides, ["side"], "v", SANITY_LEVELS, [F.max("v").alias("max")])


def scale_warning(stats: DataFrame) -> DataFrame:
    """One row with a warning text, empty if the scales of both sides agree."""
    wide = stats.agg(
        F.max(F.when(F.col("side") == "y_true", F.col("p99"))).alias("p99_true"),
        F.max(F.when(F.col("side") == "y_pred", F.col("p99"))).alias("p99_pred"),
    )
    ratio = F.try_divide("p99_pred", "p99_true")
    text = (
        F.when(F.col("p99_pred") <= 0, F.lit("predictions may be on the wrong scale: p99 is not positive"))
        .when(
            (F.col("p99_true") > 0) & ((ratio < 0.1) | (ratio > 10.0)),
            F.format_string("prediction scale seems off: p99 ratio is %.3f", ratio),
        )
        .otherwise(F.lit(""))
    )
    return wide.withColumn("warning", text)


def group_errors(
    scored: DataFrame, group: str, truth: str = "y_true", pred: str = "y_pred"
) -> DataFrame:
    """Count, mean error, RMSE and median relative error per group; NULL is a group."""
    return stats_with_quantiles(
        with_errors(scored, truth, pred),
        [group],
        "ape",
        {"median_ape": 0.5},
        [
            F.count(F.lit(1)).alias("count"),
            F.avg("abs_error").alias("mean_abs_error"),
            F.sqrt(F.avg("sq_error")).alias("rmse"),
        ],
    )


def group_error_spread(
    scored: DataFrame, group: str, truth: str = "y_true", pred: str = "y_pred"
) -> DataFrame:
    """``group_errors`` with the median error and the 90 % relative error."""
    errors = with_errors(scored, truth, pred)
    base = stats_with_quantiles(
        errors,
        [group],
        "ape",
        {"median_ape": 0.5, "p90_ape": 0.9},
        [
            F.count(F.lit(1)).alias("count"),
            F.avg("abs_error").alias("mean_abs_error"),
            F.sqrt(F.avg("sq_error")).alias("rmse"),
        ],
    )
    medians = exact_quantiles(errors, [group], "abs_error", {"median_abs_error": 0.5})
    right = medians.withColumnRenamed(group, "_group")
    return base.join(right, base[group].eqNullSafe(right["_group"]), "left").drop("_group")


def scatter_points(scored: DataFrame, keys: list[str], limit: int = 60_000, seed: int = 42) -> DataFrame:
    """Sampled (truth, prediction) points of the scatter chart."""
    return hash_sample(scored, keys, n=limit, seed=seed)


def guide_line(points: DataFrame, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """1 % and 99 % of all coordinates, the ends of the line of perfect match."""
    both = points.select(F.explode(F.array(F.col(truth).cast("double"), F.col(pred).cast("double"))).alias("v"))
    return exact_quantiles(both, [], "v", {"low": 0.01, "high": 0.99})


def residual_histogram(
    scored: DataFrame, truth: str = "y_true", pred: str = "y_pred", bins: int = 60
) -> DataFrame:
    """Counts of residuals, clipped to their 1 % and 99 % quantiles, in equal bins."""
    residual = scored.select((F.col(pred) - F.col(truth)).cast("double").alias("_r"))
    ends = exact_quantiles(residual, [], "_r", {"low": 0.01, "high": 0.99}).first()
    low, high = ends["low"], ends["high"]
    clipped = F.least(F.greatest("_r", F.lit(low)), F.lit(high))
    slot = F.when(F.lit(high) > F.lit(low), F.least(F.floor((clipped - low) / F.lit((high - low) / bins)), F.lit(bins - 1)))
    counted = residual.groupBy(F.coalesce(slot, F.lit(0)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    width = (high - low) / bins
    return counted.select(
        "bin", (F.lit(low) + F.col("bin") * width).alias("from_value"), (F.lit(low) + (F.col("bin") + 1) * width).alias("to_value"), "rows"
    )


def hardest_groups(errors: DataFrame, group: str, k: int = 20) -> DataFrame:
    return errors.orderBy(F.desc("mean_abs_error"), F.asc(group)).limit(k)


def top_and_bottom(ranked: DataFrame, rank: str, k: int = 10) -> DataFrame:
    """First and last k rows by rank, labelled; a row may be in both."""
    total = ranked.agg(F.max(rank)).scalar()
    top = ranked.where(F.col(rank) <= k).withColumn("importance_bucket", F.lit("most_important"))
    low = ranked.where(F.col(rank) > total - k).withColumn("importance_bucket", F.lit("least_important"))
    return top.unionByName(low)


def ranked_by(df: DataFrame, value: str, name: str, rank: str) -> DataFrame:
    """Rank by descending value over one row per feature; ties by name."""
    return df.withColumn(rank, F.row_number().over(Window.orderBy(F.desc(value), F.asc(name))))
