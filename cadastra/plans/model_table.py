"""The wide model table: property features, yearly series and group history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cadastra.functions.numbers import (
    building_age_bin,
    improvement_recency_bin,
    null_outside,
    number_of,
    to_year,
    years_between,
)
from cadastra.functions.postal import postal_code, postal_fsa
from cadastra.functions.text import pair_key, plan_code
from cadastra.operators.checks import RowGuard, has_unique_keys, new_columns, require_columns
from cadastra.operators.counts import literal_summary, null_rates, summary_rows, union_all, wide_to_summary
from cadastra.operators.history import attach_history, group_history, history_names
from cadastra.operators.yearly import merge_yearly
from cadastra.plans.clean_fact import FactColumns
from cadastra.session import stage

CENTRE_YEAR = 2023
MAX_AGE = 250


def load_fact(df: DataFrame, cols: FactColumns) -> DataFrame:
    """Facts with a numeric year and a positive target."""
    require_columns(df, [cols.target, cols.year, cols.neighbourhood, cols.postal], "fact table")
    typed = df.withColumns({cols.year: to_year(number_of(df, cols.year)), cols.target: number_of(df, cols.target)})
    return typed.where(F.col(cols.year).isNotNull() & (F.col(cols.target) > 0))


def property_columns(
    df: DataFrame, cols: FactColumns, zoning: str = "ZONING_CLASSIFICATION", centre: int = CENTRE_YEAR
) -> dict[str, Column]:
    """Year, age, bin, postal and interaction columns; parts without input are left out."""
    out = {"REPORT_YEAR_NUM": F.col(cols.year), "REPORT_YEAR_CENTERED": F.col(cols.year) - centre}
    if cols.built in df.columns:
        built = number_of(df, cols.built)
        out[cols.built] = built
        out["PROPERTY_AGE"] = null_outside(years_between(cols.year, built), 0, MAX_AGE)
        out["BUILDING_AGE_BIN"] = building_age_bin(built)
    if cols.improved in df.columns:
        improved = number_of(df, cols.improved)
        since = null_outside(years_between(cols.year, improved), 0, MAX_AGE)
        out[cols.improved] = improved
        out["YEARS_SINCE_IMPROVEMENT"] = since
        out["HAS_BIG_IMPROVEMENT"] = improved.isNotNull().cast("int")
        out["IMPROVEMENT_RECENCY_BIN"] = improvement_recency_bin(since)
    out[cols.postal] = postal_code(cols.postal)
    out["POSTAL_FSA"] = postal_fsa(postal_code(cols.postal))
    if cols.plan in df.columns:
        out[cols.plan] = plan_code(cols.plan)
    if cols.legal in df.columns and zoning in df.columns:
        out["LEGAL_ZONING_COMBO"] = pair_key(cols.legal, zoning)
    return out


def property_features(df: DataFrame, cols: FactColumns | None = None) -> DataFrame:
    return df.withColumns(property_columns(df, cols or FactColumns()))


def census_decision(
    df: DataFrame, census: DataFrame | None, merge: bool, keys: list[str]
) -> tuple[str, str | None]:
    """Whether the census can be joined: a status, and the key if it can."""
    if not merge:
        return "deferred_default", None
    if census is None:
        return "deferred_missing_input", None
    shared = [k for k in keys if k in census.columns and k in df.columns]
    if not shared:
        return "deferred_no_shared_geo_key", None
    if not [c for c in census.columns if c.startswith("census_")]:
        return "deferred_no_census_features", None
    if not has_unique_keys(census, shared[:1]):
        return "deferred_non_unique_geo_key", None
    return f"merged_on_{shared[0]}", shared[0]


def merge_census(
    df: DataFrame, census: DataFrame | None, merge: bool, keys: list[str]
) -> tuple[DataFrame, str]:
    status, key = census_decision(df, census, merge, keys)
    if key is None:
        return df, status
    features = [c for c in census.columns if c.startswith("census_")]
    return df.join(stage(census.select(key, *features)), key, "left"), status


def history_families(cols: FactColumns) -> list[tuple[str, str, bool, list[str]]]:
    """(group column, prefix, extended, columns kept) of the three histories."""
    basic = lambda p: [n for n in history_names(p, "land_value", False) if not n.endswith("growth_rate")]
    return [
        (cols.neighbourhood, "neigh", True, history_names("neigh", "land_value", True)),
        ("POSTAL_FSA", "fsa", False, basic("fsa")),
        (cols.plan, "plan", False, basic("plan")),
    ]


def build_model_table(
    fact: DataFrame,
    sources: dict[str, DataFrame | None],
    census: DataFrame | None = None,
    census_wanted: bool = False,
    cols: FactColumns | None = None,
    guard: RowGuard | None = None,
) -> tuple[DataFrame, list[tuple[str, str, object]]]:
    """The model table and the summary rows known without a pass over it.

    All joined sides have one row per key by construction (or by the census
    check), so the row count cannot change; a ``guard`` counts both sides in the
    pass that writes the table, to prove it. ``fact`` should be dealt to all tasks
    before it is cleaned: all that follows has as many tasks as it has.
    """
    cols = cols or FactColumns()
    loaded = load_fact(fact, cols)
    made = property_columns(loaded, cols)
    # Cleaned and made once, for the histories and for the joins.
    table = stage(loaded.withColumns(made))
    normalised = {cols.postal, cols.plan, cols.built, cols.improved}
    notes = [("engineered_property_feature", c, "created") for c in made if c not in normalised]
    families = [f for f in history_families(cols) if f[0] in table.columns]
    base = table.select(cols.year, cols.target, *[f[0] for f in families])

    table = guard.before(table) if guard else table
    table, macro, statuses = merge_yearly(table, sources, cols.year)
    notes += [("engineered_macro_feature", c, "merged") for c in macro]
    notes += [("source_status", name, status) for name, status in statuses.items()]

    for group, prefix, extended, keep in families:
        history = group_history(base, cols.year, group, cols.target, prefix, extended, keep)
        table = attach_history(table, history, cols.year, group)
        notes += [("engineered_group_feature", c, "created") for c in keep]

    table, status = merge_census(table, census, census_wanted, [cols.neighbourhood, "POSTAL_FSA", cols.postal])
    notes.append(("source_status", "census_profile", status))
    return guard.after(table) if guard else table, notes


def model_table_summary(
    fact: DataFrame, table: DataFrame, notes: list[tuple[str, str, object]], cols: FactColumns | None = None
) -> DataFrame:
    """Long report: features, statuses, shape, years and null rates of the new columns."""
    cols = cols or FactColumns()
    added = new_columns(fact, table)
    shape = [
        ("table", "total_columns", len(table.columns)),
        ("table", "new_columns_count", len(added)),
        ("table", "new_columns", ",".join(added)),
        ("table", "group_feature_families", "neigh_history,fsa_history,plan_history"),
    ]
    years = F.array_sort(F.collect_set(cols.year))
    facts = table.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.concat_ws("-", F.min(cols.year), F.max(cols.year)).alias("year_coverage"),
        F.array_join(years, ",").alias("sample_years_present"),
    )
    before = load_fact(fact, cols).agg(F.count(F.lit(1)).alias("fact_rows_before"))
    return union_all(
        [
            wide_to_summary(before, "table"),
            literal_summary(table, notes + shape),
            wide_to_summary(facts, "table"),
            summary_rows(null_rates(table, added), "missing_rate", "metric", F.col("value")),
        ]
    )
