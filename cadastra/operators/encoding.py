"""Train-only encoders and imputation values, fitted and applied as joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from cadastra.functions.text import UNKNOWN
from cadastra.operators.counts import melt, most_frequent
from cadastra.operators.quantiles import exact_quantiles
from cadastra.session import stage


@dataclass
class TargetEncoder:
    """``table`` holds (feature, key, te); unseen keys take ``global_mean``."""

    table: DataFrame
    global_mean: float
    cols: list[str]


def encoder_key(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(UNKNOWN))


def fit_target_encoder(train: DataFrame, cols: list[str], target: Column) -> TargetEncoder:
    """Mean target per category of each column, all columns in one pass."""
    cols = [c for c in cols if c in train.columns]
    mean = train.agg(F.avg(target)).first()[0]
    if not cols:
        return TargetEncoder(train.sparkSession.createDataFrame([], "feature string, key string, te double"), mean, cols)
    keyed = train.select(*[encoder_key(c).alias(c) for c in cols], target.alias("_target"))
    means = melt(keyed, ["_target"], cols, "feature", "key").groupBy("feature", "key").agg(F.avg("_target").alias("te"))
    return TargetEncoder(stage(means), mean, cols)


def target_encoded(encoder: TargetEncoder, df: DataFrame, cols: list[str] | None = None, suffix: str = "_te") -> DataFrame:
    """``df`` with a ``_te`` column per encoded column present."""
    for c in cols or encoder.cols:
        if c not in df.columns:
            continue
        side = encoder.table.where(F.col("feature") == c).select(
            F.col("key").alias("_key"), F.col("te").alias(f"{c}{suffix}")
        )
        df = df.drop(f"{c}{suffix}").join(side, encoder_key(c) == F.col("_key"), "left").drop("_key")
        df = df.withColumn(f"{c}{suffix}", F.coalesce(f"{c}{suffix}", F.lit(encoder.global_mean)))
    return df


def dense_index(values: DataFrame, group: str, key: str, index: str = "index") -> DataFrame:
    """0-based position of each distinct (group, key) in the sorted keys of its group.

    The keys are sorted over all tasks; a row's place is the number of rows in
    the sort partitions before its own plus its place inside it.
    """
    ordered = values.select(group, key).distinct().orderBy(group, key)
    placed = stage(ordered.withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.select(
        group, key, F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_at")
    )
    # One row per sort partition.
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    run = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("_offset", F.coalesce(F.sum("_rows").over(run), F.lit(0))).drop("_rows")
    global_at = placed.join(offsets, "_part").withColumn("_at", F.col("_at") + F.col("_offset"))
    first = global_at.groupBy(group).agg(F.min("_at").alias("_first"))
    return global_at.join(first, group).select(group, key, (F.col("_at") - F.col("_first")).alias(index))


@dataclass
class OrdinalEncoder:
    table: DataFrame
    cols: list[str]


def fit_ordinal_encoder(train: DataFrame, cols: list[str]) -> OrdinalEncoder:
    """Position of each seen category in text order, per column."""
    text = train.select(*[F.col(c).cast("string").alias(c) for c in cols])
    seen = melt(text, [], cols, "feature", "key").where(F.col("key").isNotNull())
    return OrdinalEncoder(stage(dense_index(seen, "feature", "key")), cols)


def ordinal_encoded(encoder: OrdinalEncoder, df: DataFrame, suffix: str = "_idx") -> DataFrame:
    """``df`` with an index column per encoded column; unseen categories give -1."""
    for c in encoder.cols:
        side = encoder.table.where(F.col("feature") == c).select(
            F.col("key").alias("_key"), F.col("index").cast("double").alias(f"{c}{suffix}")
        )
        df = df.join(side, F.col(c).cast("string") == F.col("_key"), "left").drop("_key")
        df = df.withColumn(f"{c}{suffix}", F.coalesce(f"{c}{suffix}", F.lit(-1.0)))
    return df


def column_modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """``feature, mode`` of text columns, counted in one pass."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    return most_frequent(melt(text, [], cols), ["feature"], "value")


def column_medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """``feature, median`` of numeric columns, exact, in one pass."""
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    return exact_quantiles(melt(numbers, [], cols), ["feature"], "value", {"median": 0.5})


def fit_fill_values(train: DataFrame, cat_cols: list[str], numeric_cols: list[str]) -> dict[str, object]:
    """Imputation value per column: one value for each, so it fits the driver."""
    fills: dict[str, object] = {}
    if cat_cols:
        fills.update({r["feature"]: r["mode"] for r in column_modes(train, cat_cols).collect()})
    if numeric_cols:
        fills.update({r["feature"]: r["median"] for r in column_medians(train, numeric_cols).collect()})
    return fills
