"""History: missing years, leakage, and independence of the partitioning."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cadastra.operators import checks, yearly
from cadastra.operators.history import attach_history, group_history, history_names
from cadastra.session import stage
from cadastra.plans import model_table as mt

NAMES = history_names("g", "land_value", True)


@pytest.fixture(scope="module")
def facts(spark):
    rows = [(y, g, float(100 * i + y - 2019)) for i, g in enumerate(["a", "b", "c"]) for y in range(2020, 2027) for _ in range(3) if (g, y) != ("b", 2022)]
    rows += [(2021, None, 5.0), (2022, " ", 7.0), (2024, "a", 9999.0)]
    return spark.createDataFrame(rows, "year int, grp string, target double")


def history(df, **options):
    return group_history(df, "year", "grp", "target", "g", extended=True, **options)


def as_dict(df):
    return {(r["year"], r["grp"]): tuple(r[n] for n in NAMES) for r in df.collect()}


def test_previous_is_the_previous_observed_year(facts):
    got = {(r["year"], r["grp"]): r for r in history(facts).collect()}
    assert got[(2023, "b")]["g_prev_year_median_land_value"] == 102.0
    assert got[(2020, "b")]["g_prev_year_median_land_value"] is None
    assert got[(2021, "b")]["g_prev_year_growth_rate"] is None
    assert got[(2024, "c")]["g_prev_3yr_growth_trend"] == pytest.approx(1.0)
    assert got[(2022, "c")]["g_prev_3yr_growth_trend"] is None
    assert got[(2022, "c")]["g_prev_3yr_rolling_median_land_value"] == pytest.approx(201.5)
    assert got[(2021, "c")]["g_prev_3yr_rolling_median_land_value"] is None
    assert got[(2022, "Unknown")]["g_prev_year_median_land_value"] == 5.0


def test_strict_year_needs_the_calendar_year(facts):
    got = {(r["year"], r["grp"]): r for r in history(facts, strict_year=True).collect()}
    assert got[(2023, "b")]["g_prev_year_median_land_value"] is None
    assert got[(2023, "b")]["g_prev_2yr_median_land_value"] == 102.0
    assert got[(2023, "c")]["g_prev_year_median_land_value"] == 203.0


def test_later_years_do_not_leak(facts):
    changed = facts.withColumn("target", F.when(F.col("year") >= 2024, F.col("target") * 7 + 1).otherwise(F.col("target")))
    before, after = as_dict(history(facts)), as_dict(history(changed))
    assert all(before[k] == after[k] for k in before if k[0] <= 2024)
    assert any(before[k] != after[k] for k in before if k[0] > 2024)


def test_partitioning_does_not_matter(facts):
    assert as_dict(history(facts.repartition(9))) == as_dict(history(facts.coalesce(1)))


def test_attach_keeps_rows_and_normalises_the_key(facts):
    out = attach_history(facts, history(facts), "year", "grp")
    assert out.count() == facts.count()
    assert out.where("grp = ' '").first()["g_prev_year_median_land_value"] == 5.0


def test_yearly_statuses_and_lags(spark):
    source = spark.createDataFrame([("2020", "1", "x"), ("2020", "2", None), ("2022", "5", None), (None, "9", None)], "REPORT_YEAR string, a string, b string")
    table, status = yearly.prepare_yearly(source, "REPORT_YEAR")
    assert status == "merged" and table.columns == ["REPORT_YEAR", "a", "a_lag1", "a_yoy_change"]
    assert [tuple(r) for r in table.orderBy("REPORT_YEAR").collect()] == [(2020, 2.0, None, None), (2022, 5.0, 2.0, 3.0)]
    longer, _ = yearly.prepare_yearly(source, "REPORT_YEAR", extend_to=2024)
    assert [tuple(r) for r in longer.where("REPORT_YEAR > 2022").orderBy("REPORT_YEAR").collect()] == [
        (2023, None, 5.0, None), (2024, None, None, None),
    ]
    assert yearly.prepare_yearly(source, "REPORT_YEAR", extend_to=2000)[0].count() == 2
    assert yearly.prepare_yearly(None, "REPORT_YEAR")[1] == "missing_input"
    assert yearly.prepare_yearly(source.drop("a"), "REPORT_YEAR")[1] == "no_numeric_features"
    assert yearly.prepare_yearly(source.drop("REPORT_YEAR"), "REPORT_YEAR")[1] == "missing_REPORT_YEAR"


def test_model_table_shape(spark):
    rows = [
        (str(i), y, str(i % 3), 1000.0 + 10 * i + y, "STRATA", "RS", "RS-1", f"V6H{i % 2}J4", 1990.0, None if i % 2 else 2010.0, 5.0, f"P{i % 4}", "1")
        for i in range(12)
        for y in range(2020, 2027)
    ]
    schema = (
        "PID string, REPORT_YEAR int, NEIGHBOURHOOD_CODE string, CURRENT_LAND_VALUE double, LEGAL_TYPE string, ZONING_DISTRICT string, "
        "ZONING_CLASSIFICATION string, PROPERTY_POSTAL_CODE string, YEAR_BUILT double, BIG_IMPROVEMENT_YEAR double, LAND_COORDINATE double, PLAN string, LOT string"
    )
    fact = spark.createDataFrame(rows, schema).withColumns({"PROPERTY_AGE": F.lit(1.0), "YEARS_SINCE_IMPROVEMENT": F.lit(1.0)})
    series = lambda names: spark.createDataFrame([(y, *[float(y)] * len(names)) for y in range(2018, 2026)], ["REPORT_YEAR", *names])
    sources = {"rate": series(["r1", "r2"]), "people": series(["p1", "p2"]), "permits": series(["s1"]), "supply": series(["c1", "c2", "c3"])}
    guard = checks.RowGuard()
    table, notes = mt.build_model_table(fact, sources, guard=guard)
    table = stage(table)
    guard.check()
    assert guard.counts() == (84, 84) and table.count() == fact.count()
    # Cleaned columns, new property columns, yearly columns and history columns.
    assert len(table.columns) == 15 + 7 + 24 + 22
    made = [n for s, n, _ in notes if s == "engineered_property_feature"]
    assert made[:3] == ["REPORT_YEAR_NUM", "REPORT_YEAR_CENTERED", "PROPERTY_AGE"] and len(made) == 9
    assert ("source_status", "census_profile", "deferred_default") in notes
    last = table.where("REPORT_YEAR = 2026").first()
    assert last["r1"] is None and last["r1_lag1"] is None
    summary = mt.model_table_summary(fact, table, notes)
    assert summary.where("metric = 'year_coverage'").first()["value"] == "2020-2026"
    with pytest.raises(ValueError, match="missing required"):
        mt.build_model_table(fact.drop("CURRENT_LAND_VALUE"), {})


def test_guards(spark, facts):
    with pytest.raises(ValueError, match="no train or no test"):
        checks.time_split(facts, "year", 1990)
    with pytest.raises(ValueError, match="row count changed"):
        checks.require_same_rows(1, 2)
    assert not checks.has_unique_keys(facts, ["year"])
    assert checks.missing_columns(facts, ["year", "z"]) == ["z"]
