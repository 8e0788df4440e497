"""Level tables: counts that can be added to, weighted medians, completion from stored values."""

from __future__ import annotations

import random
from statistics import median

from pyspark.sql import functions as F

from __spark_entry__ import SMOKE_DIR
from cadastra.operators import completion, counts, levels
from cadastra.operators.quantiles import exact_quantiles
from cadastra.session import stage
from registry import lookups, standins

SCHEMA = "REPORT_YEAR int, NEIGHBOURHOOD_CODE string, neigh_v double, plain double, word string"
GROUPS = {"neigh_": "NEIGHBOURHOOD_CODE"}


def lookup_rows(seed, n, years=(2023, 2024, 2025)):
    draw = random.Random(seed)
    some = lambda values: draw.choice([None, *values])
    return [(draw.choice(years), some(["1", "2", "3"]), some([1.5, 2.0, 9.0]), some([float(i) for i in range(30)]), some(["a", "b", "b", "c"])) for _ in range(n)]


def counts_of(spark, rows):
    return levels.level_counts(spark.createDataFrame(rows, SCHEMA), ["neigh_v", "plain"], ["word"], groups=GROUPS)


def by_hand(rows):
    """(level, year, group, feature) -> median or mode."""
    held: dict = {}
    for year, group, *values in rows:
        for feature, value in zip(("neigh_v", "plain", "word"), values):
            if value is not None:
                keys = [("year", year, None), ("all", None, None)] + ([("neigh_", year, group)] if feature == "neigh_v" else [])
                for key in keys:
                    held.setdefault((*key, feature), []).append(value)
    mode = lambda v: min(v, key=lambda x: (-v.count(x), x))
    return {k: mode(v) if k[3] == "word" else median(v) for k, v in held.items()}


def found(values):
    return {(r["level"], r["year"], r["group"], r["feature"]): r["text"] if r["number"] is None else r["number"] for r in values.collect()}


def test_values_of_all_levels(spark):
    rows = lookup_rows(1, 300)
    assert found(levels.level_values(stage(counts_of(spark, rows)))) == by_hand(rows)
    assert found(levels.level_values(stage(counts_of(spark, [])))) == {}


def test_counts_can_be_added_to(spark):
    old, new = lookup_rows(2, 200), lookup_rows(3, 150, (2025, 2026))
    both = stage(levels.added_counts(stage(counts_of(spark, old)), counts_of(spark, new)))
    assert found(levels.level_values(both)) == by_hand(old + new)


def test_weighted_quantiles(spark):
    draw = random.Random(4)
    rows = [("g" if i % 3 else "h", float(draw.randrange(20)), draw.randrange(0, 50)) for i in range(60)]
    got = {r["k"]: (r["q"], r["n"]) for r in exact_quantiles(spark.createDataFrame(rows, "k string, v double, w long"), ["k"], "v", {"q": 0.5}, count="n", weight="w").collect()}
    for key in "gh":
        values = [v for k, v, w in rows if k == key for _ in range(w)]
        assert got[key] == (median(values), len(values))


def test_stored_values_complete_a_batch(spark, tmp_path):
    rows = lookup_rows(5, 300)
    levels.level_values(stage(counts_of(spark, rows))).write.partitionBy("level").parquet(f"{tmp_path}/values")
    values = spark.read.parquet(f"{tmp_path}/values")
    asked = [(1, 2025, "1", None, None), (2, 2025, "9", None, "x"), (3, 1990, "1", 4.0, None), (4, None, None, None, None)]
    df = spark.createDataFrame(asked, "request_id int, REPORT_YEAR int, NEIGHBOURHOOD_CODE string, plain double, word string")
    got = completion.complete_from_levels(df, values, ["neigh_v", "plain"], ["word"], groups=GROUPS).collect()
    known = by_hand(rows)
    for r, (_, year, group, plain, word) in zip(sorted(got, key=lambda r: r["request_id"]), asked):
        pick = lambda f: known.get(("neigh_", year, group, f), known.get(("year", year, None, f), known[("all", None, None, f)]))
        assert (r["neigh_v"], r["plain"], r["word"]) == (pick("neigh_v"), pick("plain") if plain is None else plain, word or pick("word"))


def test_facts_and_requests_are_dealt_before_they_are_cleaned(spark):
    """A table of one file has one task, and so had the cleaning of its rows."""
    cores = spark.sparkContext.defaultParallelism
    asked = lookups.scoring_requests(spark, SMOKE_DIR)
    assert asked.rdd.getNumPartitions() == 1
    assert completion.request_fields(asked, F.lit(2026)).rdd.getNumPartitions() >= cores
    assert standins.raw_extract(spark, SMOKE_DIR).rdd.getNumPartitions() >= cores


def test_the_model_table_is_counted_without_being_written(spark, monkeypatch):
    written = []
    monkeypatch.setattr(lookups, "stage", lambda df: written.append(df.columns) or stage(df))
    out = lookups.feature_completion(spark, SMOKE_DIR)
    assert written and all("request_id" in columns for columns in written)
    assert {r[0] for r in out.select("LOOKUP_SUPPORTED_YEAR_RANGE").distinct().collect()} == {"2020-2026"}
    bounds = counts.year_bounds(lookups.model_table_parts(spark, SMOKE_DIR)[0], "REPORT_YEAR")
    assert "Join" not in bounds._jdf.queryExecution().optimizedPlan().toString()
