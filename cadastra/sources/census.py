"""Census profile: long characteristic rows to one wide row per target geography."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cadastra.functions.numbers import footnoted_number, to_number
from cadastra.functions.text import fold, strip_ws
from cadastra.operators.checks import require_columns, require_rows
from cadastra.operators.counts import null_rates, summary_rows, wide_to_summary
from cadastra.session import stage
from cadastra.sources.delimited import read_text_table

# The columns used and the codes of the two geography levels.
PROFILE_COLUMNS = [
    "CENSUS_YEAR",
    "DGUID",
    "GEO_LEVEL",
    "GEO_NAME",
    "CHARACTERISTIC_ID",
    "CHARACTERISTIC_NAME",
    "C1_COUNT_TOTAL",
    "C10_RATE_TOTAL",
]
AREA_SCOPES = {"2021S05": "vancouver_cma", "2021A": "vancouver_csd"}


@dataclass
class Rule:
    """Where a feature comes from: a name (or name prefix), a column, a value range."""

    name: str
    column: str = "C1_COUNT_TOTAL"
    prefix: bool = False
    low: float | None = None
    high: float | None = None

    def value(self, label: Column) -> Column:
        hit = label.startswith(self.name) if self.prefix else label == self.name
        if self.low is not None:
            hit = hit & F.col(self.column).between(self.low, self.high)
        return F.when(hit, F.col(self.column))


# Characteristics of the profile.
CENSUS_RULES = {
    "census_population_2021": Rule("Population, 2021"),
    "census_avg_household_size": Rule("Average household size"),
    "census_median_household_income_2020": Rule("Median total income of household in 2020", prefix=True),
    "census_owner_households": Rule("Owner"),
    "census_renter_households": Rule("Renter"),
    "census_age_65_plus_pct": Rule("65 years and over", "C10_RATE_TOTAL", low=0, high=100),
}


def read_profile(spark: SparkSession, path: str | list[str]) -> DataFrame:
    raw = require_columns(read_text_table(spark, path, encoding="ISO-8859-1"), PROFILE_COLUMNS, "census profile")
    return raw.select(*PROFILE_COLUMNS)


def target_areas(geo: DataFrame, name: str = "vancouver", scopes: dict[str, str] = AREA_SCOPES) -> DataFrame:
    """One area per scope: the smallest code with the name and the scope's code prefix."""
    rows = geo.select(strip_ws("Geo Name").alias("GEO_NAME"), strip_ws("Geo Code").alias("DGUID"))
    scope = F.lit(None).cast("string")
    for prefix, label in scopes.items():
        scope = F.when(F.col("DGUID").startswith(prefix), F.lit(label)).otherwise(scope)
    named = rows.where(fold("GEO_NAME") == name).withColumn("geo_scope", scope).where(F.col("geo_scope").isNotNull())
    first = named.groupBy("geo_scope").agg(F.min_by(F.struct("DGUID", "GEO_NAME"), "DGUID").alias("_row"))
    return first.select("_row.DGUID", "_row.GEO_NAME", "geo_scope")


def profile_by_geo(
    rows: DataFrame,
    targets: DataFrame,
    rules: dict[str, Rule],
    order: str | Column = "CHARACTERISTIC_ID",
) -> DataFrame:
    """First non-null value per rule and target area, in the order of the characteristics.

    The semi join drops all other areas before the one aggregate; a NULL never
    wins because its order is NULL as well.
    """
    order = F.col(order).try_cast("long") if isinstance(order, str) else order
    kept = rows.join(stage(targets).select("DGUID"), "DGUID", "left_semi")
    kept = kept.withColumns(
        {
            "C1_COUNT_TOTAL": footnoted_number("C1_COUNT_TOTAL"),
            "C10_RATE_TOTAL": footnoted_number("C10_RATE_TOTAL"),
            "_label": strip_ws("CHARACTERISTIC_NAME"),
            "_order": order,
            "_year": to_number("CENSUS_YEAR").try_cast("int"),
        }
    )
    firsts = []
    for name, rule in rules.items():
        value = rule.value(F.col("_label"))
        firsts.append(F.min_by(value, F.when(value.isNotNull(), F.col("_order"))).alias(name))
    wide = kept.groupBy("DGUID").agg(
        F.min_by("_year", F.when(F.col("_year").isNotNull(), F.col("_order"))).alias("CENSUS_YEAR"), *firsts
    )
    return wide.join(targets, "DGUID").select("CENSUS_YEAR", "DGUID", "GEO_NAME", "geo_scope", *rules)


def census_profile(data: DataFrame, geo: DataFrame) -> DataFrame:
    """The profile of the target areas, refused if there are none or they have no rows."""
    targets = require_rows(target_areas(geo), "target geographies not found in the geography index")
    return require_rows(profile_by_geo(data, targets, CENSUS_RULES), "no census rows for the target geographies")


def profile_summary(profile: DataFrame) -> DataFrame:
    """Number of areas and null rate of each feature as a long report."""
    cols = [c for c in profile.columns if c.startswith("census_")]
    areas = profile.agg(F.count(F.lit(1)).alias("target_geographies"))
    rates = summary_rows(null_rates(profile, cols), "missing_rate", "metric", F.col("value"))
    return wide_to_summary(areas, "meta").unionByName(rates)
