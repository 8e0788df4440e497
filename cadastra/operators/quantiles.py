"""Exact quantiles of groups of any size.

Values are counted per (group, value) and sorted by group and value over all
tasks. A value's rank is the number of values in the sort partitions before its
own, of the same group, plus those before it in its partition. Only partitions
that hold a wanted rank are ranked inside, so no step sees more of a group in
one task than a sort partition, whatever the sizes of the groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cadastra.session import stage


def _pick(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)


def _ranks(prob: float) -> tuple[Column, Column, Column]:
    """Position of a quantile among ``_n`` sorted values, and the ranks around it."""
    pos = F.lit(float(prob)) * (F.col("_n") - 1)
    return pos, F.floor(pos), F.ceil(pos)


def _holds(rank: Column) -> Column:
    return (rank >= F.col("_base")) & (rank < F.col("_base") + F.col("_size"))


def _wanted(probs: list[float]) -> Column:
    flags = []
    for prob in probs:
        _, low, high = _ranks(prob)
        flags += [_holds(low), _holds(high)]
    return _pick(flags)


def _same(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"r{c}"]) for c in cols])


def _before(part: list[str], order: str) -> Column:
    run = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("_size").over(run), F.lit(0))


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str | Column, probs: dict[str, float], count: str | None = None, weight: str | None = None
) -> DataFrame:
    """One row per group with linearly interpolated quantiles ``{name: p}``.

    With ``weight``, a row stands for that many equal values.

    Null values are ignored; a group of nulls only gives no row. A quantile whose
    rank is a whole number is that value, infinite ones too. ``count`` names an
    optional column with the number of values.
    """
    value = F.col(value) if isinstance(value, str) else value
    points = list(probs.values())
    ids = [f"_k{i}" for i in range(len(keys))] or ["_k0"]
    keyed = [F.col(k).alias(i) for k, i in zip(keys, ids)] or [F.lit(0).alias("_k0")]

    counted = (
        df.select(*keyed, value.cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"))
        .where(F.col("_v").isNotNull())
        .groupBy(*ids, "_v")
        .agg(F.sum("_w").alias("_size"))
    )
    placed = stage(counted.orderBy(*ids, "_v").withColumn("_part", F.spark_partition_id()))
    # One row for each group and sort partition it lies in.
    runs = placed.groupBy(*ids, "_part").agg(F.sum("_size").alias("_size"))
    runs = runs.withColumns({"_base": _before(ids, "_part"), "_n": F.sum("_size").over(Window.partitionBy(*ids))})
    runs = runs.where(_wanted(points)).drop("_size")
    chosen = runs.select(*[F.col(c).alias(f"r{c}") for c in [*ids, "_part"]], F.col("_base").alias("_first"), "_n")
    inside = placed.join(chosen, _same(placed, chosen, [*ids, "_part"]))
    hits = inside.withColumn("_base", F.col("_first") + _before([*ids, "_part"], "_v")).where(_wanted(points))

    found = []
    for i, prob in enumerate(points):
        _, low, high = _ranks(prob)
        found.append(F.max(F.when(_holds(low), F.col("_v"))).alias(f"_low{i}"))
        found.append(F.max(F.when(_holds(high), F.col("_v"))).alias(f"_high{i}"))
    out = hits.groupBy(*ids).agg(F.max("_n").alias("_n"), *found)
    result = [F.col(i).alias(k) for k, i in zip(keys, ids)]
    if count:
        result.append(F.col("_n").alias(count))
    for i, (name, prob) in enumerate(probs.items()):
        pos, low, _ = _ranks(prob)
        below, gap = F.col(f"_low{i}"), F.col(f"_high{i}") - F.col(f"_low{i}")
        result.append(F.when(pos == low, below).otherwise(below + gap * (pos - low)).alias(name))
    return out.select(*result)


def stats_with_quantiles(
    df: DataFrame, keys: list[str], value: str | Column, probs: dict[str, float], aggregates: list[Column]
) -> DataFrame:
    """Quantiles of ``value`` next to ordinary aggregates, one row per group."""
    plain = df.groupBy(*keys).agg(*aggregates)
    ranked = exact_quantiles(df, keys, value, probs)
    if not keys:
        one = ranked.select(F.struct(*probs)).scalar()
        return plain.withColumn("_q", one).select(*plain.columns, *[F.col("_q")[n].alias(n) for n in probs])
    ranked = ranked.select(*[F.col(k).alias(f"r{k}") for k in keys], *probs)
    return plain.join(ranked, _same(plain, ranked, keys), "left").drop(*[f"r{k}" for k in keys])
