"""Faceted options for a table of requests.

A request narrows a lookup table step by step: year, postal area, then one
equality per facet; a step that would leave nothing is skipped. For all
requests at once, the counts of every combination of facets are computed for
the requested areas with grouping sets, and each step is an equality join that
asks whether the narrower combination exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cadastra.functions.postal import lookup_fsa, lookup_postal, postal_code, postal_fsa
from cadastra.functions.text import fold
from cadastra.session import stage

ALL_YEARS = -1

# Facets in the order they are applied, and the options returned of each.
FACET_LIMITS = {
    "LEGAL_TYPE": 50,
    "ZONING_DISTRICT": 150,
    "ZONING_CLASSIFICATION": 150,
    "NEIGHBOURHOOD_CODE": 100,
}


def _marks(n: int) -> list[str]:
    return [f"_f{i}" for i in range(n)]


def year_scope(requests: DataFrame, lookup: DataFrame, year: str, wanted: Column) -> DataFrame:
    """Requests with ``_year``: the wanted year if the lookup has it, else all years."""
    years = stage(lookup.select(F.col(year).cast("int").alias("_ly")).distinct())
    asked = requests.withColumn("_asked_year", wanted.cast("int"))
    found = asked.join(years, F.col("_asked_year") == F.col("_ly"), "left")
    return found.withColumn("_year", F.coalesce("_ly", F.lit(ALL_YEARS))).drop("_ly")


def _area_keys(postal: Column, fsa: Column) -> Column:
    """The areas a row belongs to, most precise first."""
    areas = [("postal", postal), ("fsa", fsa), ("all", F.lit(""))]
    return F.array(*[F.struct(F.lit(i).alias("_tier"), v.alias("_area")) for i, (_, v) in enumerate(areas)])


def resolve_contexts(
    requests: DataFrame,
    lookup: DataFrame,
    request_id: str,
    year: str,
    postal: str,
    facets: dict[str, str],
    default_year: Column,
    request_postal: str = "property_postal_code",
    request_year: str = "report_year",
) -> tuple[DataFrame, DataFrame]:
    """(requests with their context columns, staged cube of the requested areas).

    ``facets`` maps lookup columns to request columns. A context is ``_year``,
    ``_tier``, ``_area`` and one ``_f`` column per facet, NULL if not applied.
    """
    marks = _marks(len(facets))
    combos = stage(
        lookup.select(
            F.col(year).cast("int").alias("_year"),
            lookup_postal(postal).alias("_postal"),
            F.upper(postal_fsa(postal_code(postal))).alias("_fsa"),
            *[F.trim(F.col(c).cast("string")).alias(c) for c in facets],
        )
        .groupBy("_year", "_postal", "_fsa", *facets)
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    asked = year_scope(requests, combos, "_year", F.coalesce(F.col(request_year).cast("int"), default_year))
    asked = asked.select(
        request_id,
        "_year",
        lookup_postal(request_postal).alias("_postal"),
        lookup_fsa(request_postal).alias("_fsa"),
        *[F.nullif(fold(c), F.lit("")).alias(f"_q{i}") for i, c in enumerate(facets.values())],
    )

    # Areas: one row per year (and all years), tier and area of the lookup that a request names.
    years = F.array(F.col("_year"), F.lit(ALL_YEARS))
    placed = combos.withColumn("_y", F.explode(years)).withColumn("_a", F.explode(_area_keys(F.col("_postal"), F.col("_fsa"))))
    placed = placed.select(F.col("_y").alias("_year"), "_a.*", *facets, "_rows")
    named = asked.select("_year", F.explode(_area_keys(F.col("_postal"), F.col("_fsa"))).alias("_a")).select("_year", "_a.*")
    named = stage(named.where((F.col("_tier") == 2) | (F.col("_area") != "")).distinct())
    area = ["_year", "_tier", "_area"]
    local = placed.join(named, area, "left_semi")

    folded = {m: fold(c) for m, c in zip(marks, facets)}
    sets = [[*area, *subset] for subset in _subsets(marks)]
    cube = stage(
        local.withColumns(folded)
        .groupBy(*area, *marks)
        .agg(F.sum("_rows").alias("_rows"))
        .groupingSets([[F.col(c) for c in s] for s in sets], *area, *marks)
        .agg(F.sum("_rows").alias("_rows"))
    )

    # The most precise area that exists.
    base = cube.where(" and ".join(f"{m} is null" for m in marks)).select(*area)
    options = asked.select("*", F.explode(_area_keys(F.col("_postal"), F.col("_fsa"))).alias("_a")).select("*", "_a.*").drop("_a")
    options = options.where((F.col("_tier") == 2) | (F.col("_area") != "")).join(base, area)
    request_cols = asked.columns
    best = options.groupBy(*request_cols).agg(F.min(F.struct("_tier", "_area")).alias("_best"))
    state = best.select(*request_cols, "_best._tier", "_best._area", *[F.lit(None).cast("string").alias(m) for m in marks])

    # One facet after the other: keep it only if the narrower combination exists.
    for i, mark in enumerate(marks):
        keys = [*area, *marks[:i]]
        have = cube.where(" and ".join([f"{mark} is not null", *[f"{m} is null" for m in marks[i + 1 :]]]))
        have = have.select(*[F.col(c).alias(f"r{c}") for c in [*keys, mark]])
        on = [F.col(c).eqNullSafe(F.col(f"r{c}")) for c in keys] + [F.col(f"_q{i}") == F.col(f"r{mark}")]
        joined = state.join(have, _all(on), "left").withColumn(mark, F.col(f"r{mark}"))
        state = joined.drop(*[f"r{c}" for c in [*keys, mark]])
    dropped = ["_postal", "_fsa", *[f"_q{i}" for i in range(len(facets))]]
    return state.drop(*dropped), local


def _subsets(items: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for item in items:
        out += [[*s, item] for s in out]
    return out


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def faceted_options(
    requests: DataFrame,
    lookup: DataFrame,
    request_id: str,
    year: str,
    postal: str,
    facets: dict[str, str],
    default_year: Column,
    limits: dict[str, int] | None = None,
    **names: str,
) -> tuple[DataFrame, DataFrame]:
    """(request, context rows) and the long (request, facet, rank, option, rows) table.

    Options are ranked by frequency inside the request's context, ties by text.
    Requests that share a context share the work.
    """
    limits = limits or FACET_LIMITS
    marks = _marks(len(facets))
    area = ["_year", "_tier", "_area"]
    state, local = resolve_contexts(requests, lookup, request_id, year, postal, facets, default_year, **names)
    # The JSON text of a context leaves out facets that are not applied, so it names it uniquely.
    state = stage(state.withColumn("_context", F.to_json(F.struct(*area, *marks))))
    contexts = state.select(*area, *marks, "_context").distinct()

    # A context row matches a combination that agrees with every applied facet.
    # Every combination is offered under the masks that are asked for in its area.
    masks = contexts.select(*area, *[F.col(m).isNotNull().alias(f"u{m}") for m in marks]).distinct()
    folded = local.withColumns({m: fold(c) for m, c in zip(marks, facets)})
    offered = folded.join(masks, area).withColumns({m: F.when(F.col(f"u{m}"), F.col(m)) for m in marks})
    facts = offered.groupBy(*area, *marks, *facets).agg(F.sum("_rows").alias("_rows"))
    on = [F.col(f"c{c}").eqNullSafe(F.col(c)) for c in [*area, *marks]]
    side = contexts.select("_context", *[F.col(c).alias(f"c{c}") for c in [*area, *marks]])
    inside = facts.join(side, _all(on)).select("_context", *facets, "_rows")
    counted = stage(
        inside.unpivot(["_context", "_rows"], list(facets), "facet", "option")
        .groupBy("_context", "facet", "option")
        .agg(F.sum("_rows").alias("rows"))
    )
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("facet")]
    order = Window.partitionBy("_context", "facet").orderBy(F.desc("rows"), F.asc("option"))
    ranked = (
        counted.where(F.col("option").isNotNull())
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= max(limits.values()))
        .where(F.col("rank") <= limit)
    )
    # The options of any one facet add up to the rows of the context.
    one = counted.where(F.col("facet") == next(iter(facets)))
    sizes = one.groupBy("_context").agg(F.sum("rows").alias("context_row_count"))
    found = state.join(sizes, "_context", "left").select(
        request_id,
        F.when(F.col("_year") != ALL_YEARS, F.col("_year")).alias("used_year"),
        F.element_at(F.array(F.lit("exact"), F.lit("fsa"), F.lit("none")), F.col("_tier") + 1).alias("postal_match_mode"),
        F.coalesce("context_row_count", F.lit(0)).alias("context_row_count"),
    )
    options = state.select(request_id, "_context").join(ranked, "_context").drop("_context")
    return found, options


def options_as_arrays(options: DataFrame, request_id: str) -> DataFrame:
    """One row per (request, facet) with its options in rank order, bounded by the limits."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "option")))
    return options.groupBy(request_id, "facet").agg(F.transform(ordered, lambda x: x["option"]).alias("options"))
