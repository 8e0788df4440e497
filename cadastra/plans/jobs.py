"""The steps from raw files to scored requests, each reading and writing files.

Run one with ``spark-submit -m cadastra.plans.jobs <step> key=value ...`` or
call the functions from another program.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cadastra.operators import addresses, counts, facets, history_store, levels
from cadastra.operators.checks import RowGuard
from cadastra.operators.yearly import yearly_from_monthly, yearly_passthrough
from cadastra.plans import evaluate, importance, scoring, train
from cadastra.plans.clean_fact import clean_fact, clean_summary, read_extract
from cadastra.plans.model_table import build_model_table, model_table_summary
from cadastra.session import build_session, dealt, stage
from cadastra.sources import census as census_source
from cadastra.sources import sheets
from cadastra.sources.delimited import path_exists, read_columns, read_optional_table, read_text_table
from cadastra.sources.monthly import read_monthly
from cadastra.sources.sinks import write_report, write_table
from cadastra.sources.workbook import read_workbooks

YEAR = "REPORT_YEAR"

# Sheets of the two workbooks and columns of the rental supply table.
RESIDENT_SHEET = "PR - CMA"
PERMIT_SHEET = "TR - SP Study Level Calendar"
SUPPLY_COLUMNS = {
    "net_change_total": "cmhc_rental_supply_net_change_total",
    "new_added": "cmhc_rental_supply_new_added",
    "existing_converted": "cmhc_rental_supply_existing_converted",
}
ERROR_SCHEMA = "NEIGHBOURHOOD_CODE string, count long, mean_abs_error double, rmse double, median_ape double"


def clean(spark: SparkSession, extract: str, out: str, summary: str) -> None:
    raw = read_extract(spark, extract)
    write_table(clean_fact(raw), out, [YEAR])
    # The report reads the written table instead of cleaning again.
    write_report(clean_summary(raw, spark.read.parquet(out)), summary)


def _write_series(df: DataFrame, out: str, report: str, note: str | None = None) -> None:
    df = stage(df)
    write_table(df, out)
    write_report(df.orderBy(YEAR), report, note)


def mortgage_rates(spark: SparkSession, source: str, out: str, report: str) -> None:
    names = ("mortgage_rate_5yr_avg", "mortgage_rate_5yr_end_of_year")
    _write_series(yearly_from_monthly(read_monthly(spark, source), "date", "value", *names, YEAR), out, report)


def permanent_residents(spark: SparkSession, source: str, out: str, report: str, sheet: str = RESIDENT_SHEET) -> None:
    series, note = sheets.permanent_residents(stage(read_workbooks(spark, source, sheet)), YEAR)
    _write_series(series.drop(*sheets.BOOK), out, report, note)


def study_permits(spark: SparkSession, source: str, out: str, report: str, sheet: str = PERMIT_SHEET) -> None:
    series, note = sheets.study_permits(stage(read_workbooks(spark, source, sheet)), YEAR)
    _write_series(series.drop(*sheets.BOOK), out, report, note)


def rental_supply(spark: SparkSession, source: str, out: str, report: str) -> None:
    raw = read_columns(spark, source, ["Year", *SUPPLY_COLUMNS], what="rental supply table")
    _write_series(yearly_passthrough(raw, "Year", YEAR, SUPPLY_COLUMNS), out, report)


def census(spark: SparkSession, source: str, geo_index: str, out: str, report: str) -> None:
    geo = read_text_table(spark, geo_index, encoding="ISO-8859-1")
    profile = stage(census_source.census_profile(census_source.read_profile(spark, source), geo))
    write_table(profile, out)
    write_report(census_source.profile_summary(profile), report)


def model_table(
    spark: SparkSession, fact: str, out: str, summary: str, census: str | None = None, merge_census: str = "no", **series: str
) -> None:
    """``series`` names the yearly tables; a path that is not there is reported, not an error."""
    read = lambda path: spark.read.parquet(path) if path and path_exists(spark, path) else None
    facts = spark.read.parquet(fact)
    sources = {name: read(path) for name, path in series.items()}
    guard = RowGuard()
    table, notes = build_model_table(dealt(facts), sources, read(census), merge_census == "yes", guard=guard)
    write_table(table, out, [YEAR])
    guard.check()
    written = spark.read.parquet(out).select(*table.columns)
    write_report(model_table_summary(facts, written, notes), summary)


def add_history(spark: SparkSession, fact: str, state: str, group: str = "NEIGHBOURHOOD_CODE", target: str = "CURRENT_LAND_VALUE") -> None:
    """Merges new facts into the stored counts and statistics that the history of a group comes from."""
    history_store.add_facts(spark, spark.read.parquet(fact), state, YEAR, group, target)


def train_model(
    spark: SparkSession, table: str, model: str, reports: str, encoding_mode: str = "b", sample_fraction: str = "1.0", trees: str = "100"
) -> None:
    settings = train.TrainSettings(encoding_mode=encoding_mode, sample_fraction=float(sample_fraction), trees=int(trees))
    bundle, scored, before = train.train_and_score(spark.read.parquet(table), settings)
    report = lambda df, name: write_report(df, f"{reports}/{name}")
    kept = [c for c in ("PID", YEAR, "NEIGHBOURHOOD_CODE", "LEGAL_TYPE") if c in scored.columns]
    rows = stage(scored.select(*kept, "y_true", "y_pred"))
    if "NEIGHBOURHOOD_CODE" not in kept:
        rows = rows.withColumn("NEIGHBOURHOOD_CODE", F.lit("Unknown"))

    report(train.result_row(bundle, rows, before), "model_metrics")
    stats = stage(evaluate.sanity_stats(rows))
    report(stats, "model_sanity")
    report(evaluate.scale_warning(stats), "model_scale_warning")
    by_area = stage(evaluate.group_errors(rows, "NEIGHBOURHOOD_CODE"))
    report(by_area, "model_neighbourhood_error")
    report(evaluate.hardest_groups(by_area, "NEIGHBOURHOOD_CODE"), "chart_hardest_groups")
    if "LEGAL_TYPE" in kept:
        report(evaluate.group_error_spread(rows, "LEGAL_TYPE"), "model_legal_type_error")
    points = stage(evaluate.scatter_points(rows, [c for c in ("PID", YEAR) if c in kept]))
    report(points.select("y_true", "y_pred"), "chart_scatter")
    report(evaluate.guide_line(points), "chart_scatter_guide")
    report(evaluate.residual_histogram(rows), "chart_residuals")

    ranked = stage(importance.importance_table(importance.native_importance(bundle)))
    report(ranked, "model_feature_importance")
    report(importance.grouped_importance(ranked), "model_feature_importance_grouped")
    report(importance.importance_extremes(ranked), "model_feature_importance_extremes")
    report(importance.explained_importance(ranked), "model_feature_importance_explained")
    report(importance.top_importances(ranked), "chart_importance")
    train.save_bundle(bundle, model)


def completion_levels(spark: SparkSession, table: str, out: str, added_to: str | None = None) -> None:
    """Value counts of a model table and the completion values of all levels.

    With ``added_to``, the folder of an earlier run, ``table`` holds new rows
    only and the earlier counts are kept.
    """
    lookup = spark.read.parquet(table)
    settings = train.TrainSettings()
    features = counts.feature_columns(lookup, {settings.target, settings.year, *settings.ids})
    categorical, numeric = counts.column_kinds(lookup.select(*sorted(features)))
    made = levels.level_counts(lookup, numeric, categorical, YEAR)
    if added_to:
        made = levels.added_counts(spark.read.parquet(f"{added_to}/counts"), made)
    write_table(made, f"{out}/counts")
    write_table(levels.level_values(spark.read.parquet(f"{out}/counts")), f"{out}/values", ["level"])


def score(spark: SparkSession, requests: str, model: str, lookup: str, reports: str, out: str, refused: str, completion: str | None = None) -> None:
    """``completion`` names the folder of ``completion_levels``; without it the lookup is counted for this batch."""
    bundle = train.load_bundle(spark, model)
    values = spark.read.parquet(f"{completion}/values") if completion else None
    asked = spark.read.parquet(requests)
    errors = read_optional_table(spark, f"{reports}/model_neighbourhood_error", ERROR_SCHEMA)
    metrics_path = f"{reports}/model_metrics"
    metrics = read_text_table(spark, metrics_path) if path_exists(spark, metrics_path) else errors.select()
    write_table(scoring.score_requests(asked, bundle, spark.read.parquet(lookup), errors, metrics, level_values=values), out)
    write_table(scoring.refused_requests(asked, bundle.default_year), refused)


def address_table(spark: SparkSession, extract: str, out: str) -> None:
    """Rows usable for address lookup, from the columns of the extract that it needs."""
    optional = ["BIG_IMPROVEMENT_YEAR", *addresses.CIVIC_COLUMNS]
    raw = read_columns(spark, extract, addresses.ADDRESS_REQUIRED, optional, sep=";", what="address source")
    write_table(addresses.address_table(raw), out)


def address_index(spark: SparkSession, addresses_table: str, out: str, max_limit: str = str(addresses.MAX_LIMIT)) -> None:
    """The stored index that batches of address requests are answered from."""
    addresses.write_address_index(spark.read.parquet(addresses_table), out, int(max_limit))


def address_lookup(spark: SparkSession, requests: str, index: str, default_year: str, out: str, outcome: str, refused: str | None = None) -> None:
    """Candidates of a table of requests from the stored index, and one row for each request on how it went."""
    asked = spark.read.parquet(requests)
    stored = addresses.open_address_index(spark, index)
    found = stage(addresses.resolve_addresses(asked, stored, F.lit(int(default_year))))
    write_table(found, out)
    if refused:
        write_table(addresses.limit_errors(asked, stored.max_limit), refused)
    write_table(addresses.lookup_outcome(asked, found), outcome)


def options(spark: SparkSession, requests: str, lookup: str, default_year: str, out: str, contexts: str) -> None:
    """Ranked options of every field for a table of partly filled requests."""
    context, ranked = facets.faceted_options(
        spark.read.parquet(requests), spark.read.parquet(lookup), "request_id", YEAR, "PROPERTY_POSTAL_CODE",
        {c: c.lower() for c in facets.FACET_LIMITS}, F.lit(int(default_year)), facets.FACET_LIMITS,
    )
    write_table(ranked, out)
    write_table(context, contexts)


STEPS: dict[str, Callable[..., None]] = {
    f.__name__: f
    for f in (clean, mortgage_rates, permanent_residents, study_permits, rental_supply, census, model_table, add_history, train_model, completion_levels, score, address_table, address_index, address_lookup, options)
}


def main(args: list[str]) -> None:
    if not args or args[0] not in STEPS:
        raise SystemExit(f"first argument must be one of {sorted(STEPS)}")
    STEPS[args[0]](build_session(), **dict(a.split("=", 1) for a in args[1:]))


if __name__ == "__main__":
    main(sys.argv[1:])
