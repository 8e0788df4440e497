"""Cleaning of the yearly assessment extract and its summary."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from cadastra.functions.numbers import null_outside, number_of, years_between
from cadastra.functions.postal import postal_code
from cadastra.functions.text import plan_code, unknown_if_empty
from cadastra.operators.checks import require_columns
from cadastra.operators.counts import null_rates, summary_rows, top_values, union_all, value_counts, wide_to_summary
from cadastra.sources.delimited import read_text_table

# Columns of the extract, by the rule that cleans them.
CATEGORY_COLUMNS = ["LEGAL_TYPE", "ZONING_DISTRICT", "ZONING_CLASSIFICATION", "NEIGHBOURHOOD_CODE"]
YEAR_COLUMNS = ["YEAR_BUILT", "BIG_IMPROVEMENT_YEAR"]


@dataclass
class FactColumns:
    """Column roles of a yearly fact table, and its cleaning limits."""

    id: str = "PID"
    year: str = "REPORT_YEAR"
    target: str = "CURRENT_LAND_VALUE"
    neighbourhood: str = "NEIGHBOURHOOD_CODE"
    postal: str = "PROPERTY_POSTAL_CODE"
    legal: str = "LEGAL_TYPE"
    coordinate: str = "LAND_COORDINATE"
    plan: str = "PLAN"
    lot: str = "LOT"
    categories: list[str] = field(default_factory=lambda: list(CATEGORY_COLUMNS))
    built: str = "YEAR_BUILT"
    improved: str = "BIG_IMPROVEMENT_YEAR"
    first_year: int = 2020
    last_year: int = 2026
    oldest_year: int = 1800

    @property
    def kept(self) -> list[str]:
        rest = [c for c in self.categories if c not in (self.neighbourhood, self.legal)]
        return [
            self.id,
            self.year,
            self.neighbourhood,
            self.target,
            self.legal,
            *rest,
            self.postal,
            self.built,
            self.improved,
            self.coordinate,
            self.plan,
            self.lot,
        ]


def read_extract(spark: SparkSession, path: str | list[str], cols: FactColumns | None = None) -> DataFrame:
    cols = cols or FactColumns()
    raw = read_text_table(spark, path, sep=";")
    return require_columns(raw, cols.kept, "extract").select(*cols.kept)


def keep_valid_facts(df: DataFrame, cols: FactColumns) -> DataFrame:
    """Rows with a positive target and a year inside the limits."""
    year = F.col(cols.year)
    return df.where((F.col(cols.target) > 0) & year.between(cols.first_year, cols.last_year))


def clean_fact(raw: DataFrame, cols: FactColumns | None = None) -> DataFrame:
    """Typed, filtered and normalised facts: one projection, one filter, one projection."""
    cols = cols or FactColumns()
    require_columns(raw, cols.kept, "extract")
    numbers = (cols.target, cols.year, cols.coordinate, cols.built, cols.improved)
    typed = raw.select(*cols.kept).withColumns({c: number_of(raw, c) for c in numbers})
    kept = keep_valid_facts(typed, cols).withColumns(
        {
            **{c: null_outside(c, cols.oldest_year, F.col(cols.year)) for c in (cols.built, cols.improved)},
            **{c: unknown_if_empty(c) for c in cols.categories},
            cols.postal: postal_code(cols.postal),
            cols.plan: plan_code(cols.plan),
            cols.lot: plan_code(cols.lot),
        }
    )
    return kept.withColumns(
        {
            cols.year: F.col(cols.year).cast("int"),
            "PROPERTY_AGE": years_between(cols.year, cols.built),
            "YEARS_SINCE_IMPROVEMENT": years_between(cols.year, cols.improved),
        }
    )


def clean_summary(raw: DataFrame, clean: DataFrame, cols: FactColumns | None = None, top: int = 20) -> DataFrame:
    """Long report of row counts, null rates, coverage and frequent values."""
    cols = cols or FactColumns()
    strata = clean.where(F.upper(cols.legal) == "STRATA")
    strata_profile = strata.agg(
        F.count(F.lit(1)).alias("strata_rows"),
        F.count_distinct(cols.plan).alias("strata_unique_plan"),
        F.count_distinct(cols.lot).alias("strata_unique_lot"),
    ).where(F.col("strata_rows") > 0)
    measured = [cols.target, cols.built, cols.improved, cols.coordinate, cols.postal, cols.plan, cols.lot]
    parts = [
        wide_to_summary(raw.agg(F.count(F.lit(1)).alias("total_rows_before")), "rows"),
        wide_to_summary(clean.agg(F.count(F.lit(1)).alias("total_rows_after")), "rows"),
        summary_rows(null_rates(clean, measured, digits=6), "missing_rate", "metric", F.col("value")),
        summary_rows(value_counts(clean, cols.year), "count_by_report_year", cols.year, F.col("count")),
    ]
    for col, section in [(cols.neighbourhood, "neighbourhood_code"), (cols.plan, "plan")]:
        frequent = top_values(clean, col, top)
        parts.append(summary_rows(frequent, f"count_by_{section}_top{top}", col, F.col("count")))
    parts.append(wide_to_summary(strata_profile, "strata_plan_lot_profile"))
    return union_all(parts)
