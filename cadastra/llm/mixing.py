"""Mixing sources to target weights, to the word where the lengths allow it.

Documents are counted by source and exact length. Whole repeats of a source are
taken as often as its target holds them; of the rest every length gives its
proportional share, long lengths fill up what is missing, and a bounded knapsack
over the lengths still available closes the last gap. The documents of a length
are then chosen by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cadastra.session import stage

#: Words that the knapsack closes exactly: so many, and so many times the longest length at least. What is missing before it is
#: filled from the longest length down.
KNAPSACK_WORDS = 20_000
KNAPSACK_LONGEST = 4
#: Steps of the knapsack between the sums that it keeps.
KEPT_STEPS = 64
#: Documents of one source and length that are ranked together.
CELL_ROWS = 512


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """(source, source_size, target) from one (source, source_size) row for each source.

    Sources in code-point order, null last, take ``weights`` in turn and share
    the sum of all sizes. A target stops at ``max_repeats`` times its source's
    size, and the excess is shared by weight among the others until no target is
    above. Sorted by size for each unit of weight, the sources that stop come
    first: source i stops if its share of what those before it leave exceeds its
    limit. The windows run over one row for each source.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), order % len(weights))
    limit = (F.col("source_size") * max_repeats).cast("double")
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    ranked = sizes.withColumn("weight", weight).withColumn("limit", limit)
    level = ranked.withColumn("level", left / F.sum("weight").over(after)).withColumn("stops", F.col("level") * F.col("weight") > F.col("limit"))
    shared = F.min(F.when(~F.col("stops"), F.struct(F.col("limit") / F.col("weight"), F.col("level")))).over(everything).getField("level")
    return level.select("source", "source_size", F.when(F.col("stops"), F.col("limit")).otherwise(F.col("weight") * shared).alias("target"))


def fill_budget(lengths: Sequence[int], counts: Sequence[int], budget: int) -> np.ndarray:
    """How many of each length to take, so that their sum comes as near to ``budget`` from below as found.

    The rest that the knapsack gets is at most its window if there are lengths to
    fill it with; over it the result is the best there is. The window holds
    several of the longest documents, so it never shuts one out that would fit.
    """
    length, count = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((length * count).sum())
    if budget >= total:
        return count.copy()
    window = max(KNAPSACK_WORDS, KNAPSACK_LONGEST * int(length.max(initial=0)))
    taken = np.array([int(c) * max(0, budget - window // 2) // total for c in count.tolist()], np.int64)
    rest = budget - int((length * taken).sum())
    for i in np.argsort(-length, kind="stable"):
        if rest <= window:
            break
        more = max(0, min(int(count[i] - taken[i]), (rest - window // 2) // max(1, int(length[i]))))
        taken[i] += more
        rest -= more * int(length[i])
    return taken + _knapsack(length, count - taken, rest)


def _knapsack(length: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: sums that can be reached are bits of one number, each length in binary parts.

    The sums before every ``KEPT_STEPS``th step are kept; on the way back, those
    in between are worked out again.
    """
    used = np.zeros(len(length), np.int64)
    steps: list[tuple[int, int, int]] = []  # length, how many at once, its sum
    kept: list[int] = []
    reached, mask = 1, (1 << (budget + 1)) - 1
    for i in np.argsort(length, kind="stable"):
        size = int(length[i])
        if size == 0 or size > budget or reached >> budget & 1:
            continue
        left, part = min(int(free[i]), budget // size), 1
        while left and not reached >> budget & 1:
            part = min(part, left)
            if len(steps) % KEPT_STEPS == 0:
                kept.append(reached)
            steps.append((i, part, size * part))
            reached |= reached << size * part & mask
            left -= part
            part *= 2
    at = reached.bit_length() - 1
    for block in range(len(kept) - 1, -1, -1):
        some = steps[block * KEPT_STEPS : (block + 1) * KEPT_STEPS]
        before = [kept[block]]
        for _, _, size in some[:-1]:
            before.append(before[-1] | before[-1] << size & mask)
        for (i, part, size), sums in zip(reversed(some), reversed(before)):
            if not sums >> at & 1:
                used[i] += part
                at -= size
    return used


def _plan_source(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Repeats and extra documents for each length of one source."""
    rows = rows.sort_values("size").reset_index(drop=True)
    size, target = int(rows.source_size[0]), float(rows.target[0])
    repeats = int(target // size) if size else 0
    extra = fill_budget(rows["size"].tolist(), rows.n.tolist(), round(target - repeats * size)) if size else 0
    return pd.DataFrame({"source_key": key[0], "size": rows["size"], "repeats": repeats, "extra": extra})


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3,
    seed: int = 17,
) -> DataFrame:
    """``id_col``, size, source_size, target and taken (words, repeats counted) of every row.

    ``taken`` is a multiple of the size, at most ``max_repeats`` times. Reruns
    agree: documents of one length are chosen by a hash of the seed and their
    id, then by id; null ids and repeated rows are ranked like any other, so of
    rows that are alike in all columns some may be taken and some not. A null or
    empty text has size 0 and nothing taken; a null source is a source of its
    own, after all others; an empty table gives an empty result. Other columns
    are not read.

    What is grouped is counts: a source's plan sees one row for each distinct
    length, and documents of one source and length are ranked in cells of about
    ``CELL_ROWS``.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    sized = stage(docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{source_col}`"].alias("source"), word_count(docs[f"`{text_col}`"]).alias("size")
                  ).withColumn("source_key", key))
    cells = max(1, sized.count() // CELL_ROWS)
    hashed = F.xxhash64(F.lit(seed), "id")
    ranked = sized.withColumn("hash", hashed).withColumn("cell", F.pmod("hash", F.lit(cells)))

    counts = ranked.groupBy("source_key", "source", "size", "cell").agg(F.count("*").alias("n"))
    counts = stage(counts)
    lengths = counts.groupBy("source_key", "source", "size").agg(F.sum("n").alias("n"))
    targets = stage(source_targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, max_repeats))
    targets = targets.withColumn("source_key", key)

    planned = lengths.drop("source").join(targets.drop("source"), "source_key")
    planned = planned.groupBy("source_key").applyInPandas(_plan_source, "source_key string, size long, repeats long, extra long")
    before = F.sum("n").over(Window.partitionBy("source_key", "size").orderBy("cell")) - F.col("n")
    share = F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - before))
    plan = counts.join(planned, ["source_key", "size"]).select("source_key", "size", "cell", "repeats", share.alias("extra"))

    rank = F.row_number().over(Window.partitionBy("source_key", "size", "cell").orderBy("hash", "id"))
    chosen = ranked.withColumn("rank", rank).join(stage(plan), ["source_key", "size", "cell"]).join(targets.drop("source"), "source_key")
    times = F.col("repeats") + F.when(F.col("rank") <= F.col("extra"), 1).otherwise(0)
    return chosen.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * times).alias("taken"))
