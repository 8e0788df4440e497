"""Batch lookups: options, addresses, ranges, request checks, completion and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.operators import addresses, completion, counts, facets, ranges, requests
from cadastra.plans import evaluate, scoring, train
from cadastra.session import stage
from registry import standins as st
from registry.cleaning import ADDRESS_PARTS, FACT
from registry.core import query, rounded, sql_number, table, with_sql
from registry.modeling import GROUP_ERRORS, SCORED, scored, split, trained_model
from registry.series import MODEL_PARTS, PLAIN_HISTORY, PLAIN_MODEL_PARTS, model_table_parts

LIMITS = {"LEGAL_TYPE": 50, "ZONING_DISTRICT": 150, "ZONING_CLASSIFICATION": 150, "NEIGHBOURHOOD_CODE": 10}

# One request per customer, in texts both engines understand.
REQUEST = {
    "request_id": "c_custkey",
    "property_postal_code": "case when c_custkey % 9 = 0 then '' else concat('V', c_custkey % 11, substr('ABCEGHJKLM', cast(1 + c_custkey % 7 as int), 1), "
    "'-', c_nationkey % 4, 'B', c_custkey % 2) end",
    "legal_type": "case c_custkey % 4 when 0 then 'strata' when 1 then ' LAND' when 2 then '' else 'nothing' end",
    "zoning_district": "case when c_custkey % 3 = 0 then '1-urgent' when c_custkey % 3 = 1 then null else '5-LOW' end",
    "zoning_classification": "case when c_custkey % 5 < 3 then lower(c_mktsegment) else '' end",
    "neighbourhood_code": "case when c_custkey % 2 = 0 then cast(c_nationkey as string) else '' end",
    "report_year": "case when c_custkey % 6 = 5 then null else cast(2020 + c_custkey % 9 as int) end",
    "street_number": "case when c_custkey % 19 = 0 then 'x' else concat(' ', c_custkey % 420, case when c_custkey % 4 = 0 then 'A' else '' end) end",
    "street_name": "case c_custkey % 6 when 0 then concat(c_custkey % 30, 'th ave w') when 1 then 'Ave.' when 2 then concat(c_custkey % 30, 'TH-ST') "
    "when 3 then '' when 4 then 'zzz' else 'th  s' end",
    "limit": "cast(1 + c_custkey % 50 as int)",
}


def request_sql() -> str:
    cols = ", ".join(f'{st._duck(e)} as "{n}"' for n, e in REQUEST.items())
    return f"select {cols} from customer"


def request_table(spark, sf):
    return table(spark, sf, "customer").select(*[F.expr(e).alias(n) for n, e in REQUEST.items()])


_FACETS = [("LEGAL_TYPE", "legal_type"), ("ZONING_DISTRICT", "zoning_district"), ("ZONING_CLASSIFICATION", "zoning_classification"), ("NEIGHBOURHOOD_CODE", "neighbourhood_code")]
_YEARS = """asked as (select request_id, legal_type as a0, zoning_district as a1, zoning_classification as a2, neighbourhood_code as a3,
 street_number as a_number, street_name as a_street, "limit", replace(replace(upper(property_postal_code), ' ', ''), '-', '') as q_postal, coalesce(report_year, 2026) as asked_year,
 case when coalesce(report_year, 2026) in (select distinct REPORT_YEAR from {0}) then coalesce(report_year, 2026) end as used_year from request)"""


def _facet_steps() -> str:
    steps = [
        ("p", "select *, case when q_postal <> '' and upper(PROPERTY_POSTAL_CODE) = q_postal then 2 when q_postal <> '' and upper(POSTAL_FSA) = substr(q_postal, 1, 3) then 1 else 0 end as pt "
         "from asked join features on used_year is null or used_year = REPORT_YEAR qualify pt = max(pt) over (partition by request_id)")
    ]
    previous = "p"
    for i, (col, _) in enumerate(_FACETS):
        asked = f"a{i}"
        hit = f"cast(coalesce(trim(lower({asked})), '') <> '' and lower(trim({col})) = trim(lower({asked})) as integer)"
        name = f"f{i}"
        steps.append((name, f"select *, coalesce({hit}, 0) as t{i} from {previous} qualify t{i} = max(t{i}) over (partition by request_id)"))
        previous = name
    return ",\n".join(f"{n} as ({q})" for n, q in steps)


FACET_SQL = with_sql(*st.FEATURE_PARTS, ("request", request_sql())) + ", " + _YEARS.format("features") + ", " + _facet_steps()


def faceted(spark, sf):
    return facets.faceted_options(
        request_table(spark, sf), stage(st.features(spark, sf)), "request_id", "REPORT_YEAR", "PROPERTY_POSTAL_CODE",
        dict(_FACETS), F.lit(2026), LIMITS,
    )


@query(
    FACET_SQL
    + " select request_id, used_year, case max(pt) when 2 then 'exact' when 1 then 'fsa' else 'none' end as postal_match_mode, count(*) as context_row_count from f3 group by 1, 2"
)
def facet_contexts(spark, sf):
    return faceted(spark, sf)[0]


@query(
    FACET_SQL
    + ", long as ("
    + " union all ".join(f"select request_id, '{c}' as facet, {c} as option, count(*) as rows from f3 group by 1, 3" for c, _ in _FACETS)
    + ") select *, cast(row_number() over (partition by request_id, facet order by rows desc, option) as integer) as rank from long "
    "qualify rank <= case when facet = 'NEIGHBOURHOOD_CODE' then 10 when facet = 'LEGAL_TYPE' then 50 else 150 end"
)
def facet_options(spark, sf):
    return faceted(spark, sf)[1]


@query(FACT + "select ZONING_DISTRICT, count(*) as count from fact group by 1 order by count desc, ZONING_DISTRICT limit 3")
def top_options(spark, sf):
    return counts.top_options(st.fact(spark, sf), "ZONING_DISTRICT", 3)


_CANDIDATES = ", ".join(addresses.CANDIDATE_COLUMNS)


ADDRESS_SQL = (
    with_sql(*ADDRESS_PARTS, ("request", request_sql()))
    + ", "
    + _YEARS.format("address")
    + rf""", number as (select *, try_cast(nullif(regexp_extract(trim(a_number), '^(\d+)', 1), '') as bigint) as q_number,
 trim(regexp_replace(regexp_replace(upper(a_street), '[^A-Z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) as q_street from asked),
 hit as (select *, case when STREET_NAME_NORMALIZED = q_street then 2 when contains(STREET_NAME_NORMALIZED, q_street) then 1 else 0 end as st
  from number join address on (used_year is null or used_year = REPORT_YEAR) and q_number between CIVIC_LOW and CIVIC_HIGH
  qualify st = max(st) over (partition by request_id)),
 near as (select *, case when q_postal <> '' and POSTAL_CODE_NORMALIZED = q_postal then 2 when q_postal <> '' and POSTAL_FSA = substr(q_postal, 1, 3) then 1 else 0 end as pt
  from hit qualify pt = max(pt) over (partition by request_id)),
 single as (select request_id, "limit", asked_year, used_year, st, pt, {_CANDIDATES}, min(ROW_ID) as first_row from near group by all),
 answer as (select request_id, cast(row_number() over (partition by request_id order by first_row) as integer) as candidate_id, asked_year as used_report_year,
 used_year is null as year_fallback, case st when 2 then 'exact' when 1 then 'contains' else 'none' end as name_match_mode,
 case pt when 2 then 'exact' when 1 then 'fsa' else 'none' end as postal_match_mode,
 replace(replace(upper(PROPERTY_POSTAL_CODE), ' ', ''), '-', '') as PROPERTY_POSTAL_CODE, {_CANDIDATES.replace(' PROPERTY_POSTAL_CODE,', '')}
from single qualify candidate_id <= "limit") """
)


@query(ADDRESS_SQL + "select * from answer")
def address_resolution(spark, sf):
    table_ = stage(addresses.address_table(st.raw_addresses(spark, sf), "row_id"))
    return addresses.resolve_addresses(request_table(spark, sf), table_, F.lit(2026), max_limit=50)


@query(
    ADDRESS_SQL
    + "select request_id, count(answer.request_id) as match_count, count(answer.request_id) = 1 as auto_selected, "
    "coalesce(max(answer.postal_match_mode), 'none') as postal_match_mode from request left join answer using (request_id) group by 1"
)
def address_outcome(spark, sf):
    """Number of candidates of every request, and whether one is chosen without asking."""
    table_ = stage(addresses.address_table(st.raw_addresses(spark, sf), "row_id"))
    asked = request_table(spark, sf)
    return addresses.lookup_outcome(asked, addresses.resolve_addresses(asked, table_, F.lit(2026), max_limit=50))


@query(
    ADDRESS_SQL
    + """select request_id, case when "limit" > 20 then 'limit_out_of_range' else '' end as error, count(answer.request_id) filter ("limit" <= 20) as candidates
from request left join answer using (request_id) group by request_id, "limit\""""
)
def address_limits(spark, sf):
    """Requests for more than 20 candidates are refused; the others are answered from the index."""
    index = addresses.address_index(stage(addresses.address_table(st.raw_addresses(spark, sf), "row_id")))
    asked = request_table(spark, sf)
    found = addresses.lookup_outcome(asked, addresses.resolve_addresses(asked, index, F.lit(2026)))
    refused = addresses.limit_errors(asked, index.max_limit)
    out = found.join(refused, "request_id", "left")
    return out.select("request_id", F.coalesce(F.array_join("errors", ","), F.lit("")).alias("error"), F.col("match_count").alias("candidates"))


@query(
    "select p_partkey, p_size, s_suppkey, s_suppkey % 40 as low, s_suppkey % 40 + s_nationkey as high from part join supplier on p_size between s_suppkey % 40 and s_suppkey % 40 + s_nationkey"
)
def range_join(spark, sf):
    supplier = table(spark, sf, "supplier").select(
        "s_suppkey", (F.col("s_suppkey") % 40).alias("low"), (F.col("s_suppkey") % 40 + F.col("s_nationkey")).alias("high")
    )
    return ranges.range_join(table(spark, sf, "part").select("p_partkey", "p_size"), supplier, "p_size", "low", "high")


SCORING = {
    "request_id": "c_custkey",
    "PROPERTY_POSTAL_CODE": REQUEST["property_postal_code"].replace("'-'", "' '"),
    "LEGAL_TYPE": "case c_custkey % 4 when 0 then 'STRATA' when 1 then 'LAND' when 2 then ' OTHER ' else 'none' end",
    "ZONING_DISTRICT": "case when c_custkey % 17 = 0 then '' else '5-LOW' end",
    "ZONING_CLASSIFICATION": "c_mktsegment",
    "NEIGHBOURHOOD_CODE": "case when c_custkey % 23 = 0 then null when c_custkey % 7 = 0 then '99' else cast(c_nationkey as string) end",
    "YEAR_BUILT": "case c_custkey % 11 when 0 then '0' when 1 then '1700' when 2 then '19x0' when 3 then '1990.5' when 4 then '2025' else cast(1900 + c_custkey % 120 as string) end",
    "BIG_IMPROVEMENT_YEAR": "case when c_custkey % 3 = 0 then cast(1930 + c_custkey % 110 as string) end",
    "REPORT_YEAR": "case when c_custkey % 5 = 0 then null else cast(2018 + c_custkey % 10 as string) end",
    "PLAN": "case when c_custkey % 2 = 0 then concat('vap', c_custkey % 60) end",
}


def scoring_sql() -> str:
    return "select " + ", ".join(f"{st._duck(e)} as {n}" for n, e in SCORING.items()) + " from customer"


def scoring_requests(spark, sf):
    return table(spark, sf, "customer").select(*[F.expr(e).alias(n) for n, e in SCORING.items()])


_REQUIRED = requests.REQUIRED_FIELDS
_N = {c: f"({sql_number(c)})" for c in ("YEAR_BUILT", "REPORT_YEAR", "BIG_IMPROVEMENT_YEAR")}
_TARGET = f"coalesce({_N['REPORT_YEAR']}, 2026)"
_RULES = {
    **{f"{c}_not_a_year": f"trim({c}) <> '' and not coalesce({n} = floor({n}), false)" for c, n in _N.items()},
    "YEAR_BUILT_out_of_range": f"{_N['YEAR_BUILT']} < 1800 or {_N['YEAR_BUILT']} > {_TARGET}",
    "REPORT_YEAR_out_of_range": f"{_N['REPORT_YEAR']} < 2020 or {_N['REPORT_YEAR']} > 2026",
    "REPORT_YEAR_before_built": f"{_N['REPORT_YEAR']} < {_N['YEAR_BUILT']}",
    "BIG_IMPROVEMENT_YEAR_out_of_range": f"{_N['BIG_IMPROVEMENT_YEAR']} < 1800 or {_N['BIG_IMPROVEMENT_YEAR']} > {_TARGET}",
    "BIG_IMPROVEMENT_YEAR_before_built": f"{_N['BIG_IMPROVEMENT_YEAR']} < {_N['YEAR_BUILT']}",
}


def _absent(c: str) -> str:
    """A required field that is left out: only a year is a number, and only a number is missing as 0."""
    zero = f" or coalesce({sql_number(c)} = 0, false)" if c == "YEAR_BUILT" else ""
    return f"{c} is null or {c} = ''{zero}"


_POSTAL = "replace(upper(PROPERTY_POSTAL_CODE), ' ', '')"


@query(
    with_sql(("request", scoring_sql()))
    + "select request_id, concat_ws(',', "
    + ", ".join(f"case when {_absent(c)} then '{c}' end" for c in _REQUIRED)
    + ") as missing, concat_ws(',', "
    + ", ".join(f"case when {rule} then '{name}' end" for name, rule in _RULES.items())
    + f") as year_errors, regexp_full_match({_POSTAL}, '[A-Z][0-9][A-Z][0-9][A-Z][0-9]') as postal_ok from request"
)
def request_checks(spark, sf):
    rules = requests.year_rules("YEAR_BUILT", "REPORT_YEAR", "BIG_IMPROVEMENT_YEAR", 2020, 2026)
    return scoring_requests(spark, sf).select(
        "request_id",
        F.array_join(requests.missing_fields(), ",").alias("missing"),
        F.array_join(requests.errors(rules), ",").alias("year_errors"),
        requests.is_valid_postal("PROPERTY_POSTAL_CODE").alias("postal_ok"),
    )


@query(
    with_sql(*st.FACT_PARTS, ("request", scoring_sql()))
    + f"""select request_id, regexp_full_match({_POSTAL}, '[A-Z][0-9][A-Z][0-9][A-Z][0-9]') as postal_valid,
 {_POSTAL} in (select PROPERTY_POSTAL_CODE from fact where regexp_full_match(PROPERTY_POSTAL_CODE, '[A-Z][0-9][A-Z][0-9][A-Z][0-9]')) as postal_seen from request"""
)
def request_postal_seen(spark, sf):
    out = requests.with_postal_seen(
        scoring_requests(spark, sf), st.fact(spark, sf), "PROPERTY_POSTAL_CODE", "PROPERTY_POSTAL_CODE"
    )
    return out.select("request_id", "postal_valid", "postal_seen")


@query(
    """with option as (select distinct p_type as field, p_name as o from part), asked as (select p_partkey as request_id, p_type as field,
  case p_size % 3 when 0 then upper(p_name) when 1 then substr(p_name, 1, 5 + p_size % 4) else ' ' || replace(p_name, ' ', '   ') end as t from part),
 folded as (select request_id, field, trim(regexp_replace(lower(t), '\\s+', ' ', 'g')) as t, t as raw from asked),
 e as (select request_id, min(o) as o from folded join option using (field) where lower(o) = case when starts_with(raw, ' ') then t else rtrim(t) end group by 1),
 p as (select request_id, count(*) as n, min(o) as o from folded join option using (field) where starts_with(lower(o), t) group by 1)
select request_id, field, coalesce(e.o, case when n = 1 then p.o end) as matched,
 case when e.o is not null then 'exact' when n = 1 then 'prefix' else 'none' end as match_mode
from folded left join e using (request_id) left join p using (request_id)"""
)
def option_matching(spark, sf):
    part = table(spark, sf, "part")
    options = part.select(F.col("p_type").alias("field"), F.col("p_name").alias("o")).distinct()
    text = F.expr(
        "case p_size % 3 when 0 then upper(p_name) when 1 then substr(p_name, 1, 5 + p_size % 4) else concat(' ', replace(p_name, ' ', '   ')) end"
    )
    asked = part.select(F.col("p_partkey").alias("request_id"), F.col("p_type").alias("field"), text.alias("t"))
    return requests.match_options(asked, options, "request_id", "t", "o", ["field"])


_OWN = {"neigh": "NEIGHBOURHOOD_CODE", "fsa": "POSTAL_FSA", "plan": "PLAN"}
_WANTED = [f"{p}_prev_year_median_land_value" for p in _OWN] + ["net", "LAND_COORDINATE"]


def _completion_sql() -> str:
    year = f"case when REPORT_YEAR is null then 2026 else cast({_N['REPORT_YEAR']} as integer) end"
    unknown = lambda c: f"case when {c} is null or lower(trim({c})) in ('', 'nan', 'none', 'nat', 'unknown') then 'Unknown' else trim({c}) end"
    fields = (
        f"select request_id, {year} as y, {unknown('NEIGHBOURHOOD_CODE')} as NEIGHBOURHOOD_CODE, "
        f"case when regexp_matches({_POSTAL}, '^[A-Z][0-9][A-Z]') then substr({_POSTAL}, 1, 3) else 'Unknown' end as POSTAL_FSA, "
        "case when PLAN is null then 'Unknown' else upper(PLAN) end as PLAN from request"
    )
    ctes = [*MODEL_PARTS, ("request", scoring_sql()), ("fields", fields)]
    medians = ", ".join(f"median({c}) as {c}" for c in _WANTED)
    for p, g in _OWN.items():
        ctes.append((f"by_{p}", f"select REPORT_YEAR as y, {g}, median({p}_prev_year_median_land_value) as v from model group by 1, 2"))
    ctes.append(("by_year", f"select REPORT_YEAR as y, {medians} from model group by 1"))
    ctes.append(("overall", f"select {medians}, (select LOT from model group by 1 order by count(*) desc, LOT limit 1) as LOT from model"))
    ctes.append(("lots", "select y, LOT from (select REPORT_YEAR as y, LOT, row_number() over (partition by REPORT_YEAR order by count(*) desc, LOT) as r from model group by 1, 2) where r = 1"))
    cols = []
    for c in _WANTED:
        prefix = c.split("_")[0]
        own = f"by_{prefix}.v, " if prefix in _OWN else ""
        cols.append(f"round(coalesce({own}by_year.{c}, overall.{c}), 4) as {c}")
    joins = " ".join(f"left join by_{p} on f.y = by_{p}.y and f.{g} = by_{p}.{g}" for p, g in _OWN.items())
    return (
        with_sql(*ctes)
        + f"select request_id, {', '.join(cols)}, coalesce(lots.LOT, overall.LOT) as LOT, f.y < 2020 or f.y > 2026 as LOOKUP_YEAR_FALLBACK, '2020-2026' as LOOKUP_SUPPORTED_YEAR_RANGE "
        f"from fields f {joins} left join by_year on f.y = by_year.y left join lots on f.y = lots.y cross join overall"
    )


@query(_completion_sql())
def feature_completion(spark, sf):
    model = model_table_parts(spark, sf)[0]  # read once for its levels, so not written
    fields = completion.request_fields(scoring_requests(spark, sf), F.lit(2026))
    fields = stage(fields.select("request_id", "REPORT_YEAR", *_OWN.values()))
    out = completion.complete_features(fields, model, _WANTED, ["LOT"])
    out = completion.with_year_range(out, counts.year_bounds(model, "REPORT_YEAR"))
    return rounded(out.select("request_id", *_WANTED, "LOT", "LOOKUP_YEAR_FALLBACK", "LOOKUP_SUPPORTED_YEAR_RANGE"))


def _all_features(spark, sf):
    """Completed requests: every feature that the model could train on, theirs where they give it."""
    model = model_table_parts(spark, sf)[0]  # read once for its levels, so not written
    settings = train.TrainSettings()
    cat_cols, numeric_cols = counts.column_kinds(model.select(*sorted(counts.feature_columns(model, {settings.target, settings.year, *settings.ids}))))
    fields = stage(completion.request_fields(scoring_requests(spark, sf), F.lit(2026)).drop("errors", "missing_fields"))
    out = completion.complete_features(fields, model, numeric_cols, cat_cols)
    out = completion.with_year_range(out, counts.year_bounds(model, "REPORT_YEAR"))
    return out.select("request_id", "REPORT_YEAR", *cat_cols, *numeric_cols, "LOOKUP_YEAR_FALLBACK", "LOOKUP_SUPPORTED_YEAR_RANGE")


def _complete_sql() -> str:
    """Every feature: the request's own, else its group's and year's median, else the year's, else that of all rows."""
    year = f"case when REPORT_YEAR is null then 2026 else cast({_N['REPORT_YEAR']} as integer) end"
    unknown = lambda c: f"case when {c} is null or lower(trim({c})) in ('', 'nan', 'none', 'nat', 'unknown') then 'Unknown' else trim({c}) end as {c}"
    own = f"""select request_id, {year} as REPORT_YEAR, {st._code('PROPERTY_POSTAL_CODE', True)} as PROPERTY_POSTAL_CODE,
 {", ".join(unknown(c) for c in ("LEGAL_TYPE", "ZONING_DISTRICT", "ZONING_CLASSIFICATION", "NEIGHBOURHOOD_CODE"))}, {st._code('PLAN', False)} as PLAN,
 {_N['YEAR_BUILT']} as YEAR_BUILT, {_N['BIG_IMPROVEMENT_YEAR']} as BIG_IMPROVEMENT_YEAR, 0 as PROPERTY_AGE, 0 as YEARS_SINCE_IMPROVEMENT from request"""
    derived = st.FEATURE_PARTS[-1][1].replace("from fact", "from own")
    histories = {p: [c for c in names] for p, names in PLAIN_HISTORY.items()}
    series = ["net", "net_lag1", "net_yoy_change", "converted", "converted_lag1", "converted_yoy_change"]
    given = ["YEAR_BUILT", "BIG_IMPROVEMENT_YEAR", "PROPERTY_AGE", "YEARS_SINCE_IMPROVEMENT", "REPORT_YEAR_NUM", "REPORT_YEAR_CENTERED", "HAS_BIG_IMPROVEMENT"]
    rest = ["LAND_COORDINATE", *series, *[c for names in histories.values() for c in names]]
    texts = ["LEGAL_TYPE", "ZONING_DISTRICT", "ZONING_CLASSIFICATION", "NEIGHBOURHOOD_CODE", "PROPERTY_POSTAL_CODE", "PLAN", "POSTAL_FSA", "BUILDING_AGE_BIN", "IMPROVEMENT_RECENCY_BIN", "LEGAL_ZONING_COMBO"]
    medians = ", ".join(f"median({c}) as {c}" for c in [*given, *rest])
    ctes = [*PLAIN_MODEL_PARTS, ("request", scoring_sql()), ("own", own), ("fields", derived)]
    for p, g in _OWN.items():
        ctes.append((f"by_{p}", f"select REPORT_YEAR as y, {g}, {', '.join(f'median({c}) as {c}' for c in histories[p])} from model group by 1, 2"))
    ctes.append(("by_year", f"select REPORT_YEAR as y, {medians} from model group by 1"))
    ctes.append(("overall", f"select {medians}, (select LOT from model group by 1 order by count(*) desc, LOT limit 1) as LOT from model"))
    ctes.append(("lots", "select y, LOT from (select REPORT_YEAR as y, LOT, row_number() over (partition by REPORT_YEAR order by count(*) desc, LOT) as r from model group by 1, 2) where r = 1"))
    shown = lambda c, *sources: f"round(cast(coalesce({', '.join(sources)}, by_year.{c}, overall.{c}) as double) + 1e-7, 3) as {c}"
    cols = [f"f.{c}" for c in texts] + [shown(c, f"f.{c}") for c in given]
    for c in rest:
        prefix = c.split("_")[0]
        cols.append(shown(c, f"by_{prefix}.{c}" if prefix in _OWN else "null"))
    joins = " ".join(f"left join by_{p} on f.REPORT_YEAR = by_{p}.y and f.{g} = by_{p}.{g}" for p, g in _OWN.items())
    return (
        with_sql(*ctes)
        + f"select request_id, f.REPORT_YEAR, {', '.join(cols)}, coalesce(lots.LOT, overall.LOT) as LOT, f.REPORT_YEAR < 2020 or f.REPORT_YEAR > 2026 as LOOKUP_YEAR_FALLBACK, "
        f"'2020-2026' as LOOKUP_SUPPORTED_YEAR_RANGE from fields f {joins} left join by_year on f.REPORT_YEAR = by_year.y left join lots on f.REPORT_YEAR = lots.y cross join overall"
    )


@query(_complete_sql())
def feature_completion_all(spark, sf):
    """Every feature that the model could train on, completed from the stored levels."""
    out = _all_features(spark, sf)
    numbers = {f.name: F.round(F.col(f.name) + 1e-7, 3) for f in out.schema if f.dataType.typeName() == "double"}
    return out.withColumns(numbers)


@query(
    SCORED
    + f""", e as (select * from ({GROUP_ERRORS.replace('round(avg(abs(y_pred - y_true)), 4)', 'avg(abs(y_pred - y_true))')}) where NEIGHBOURHOOD_CODE is not null and NEIGHBOURHOOD_CODE <> '3'),
 c as (select quantile_cont(CURRENT_LAND_VALUE, 0.995) as cap from features where REPORT_YEAR < 2024),
 m as (select avg(abs(least(y_pred, cap) - least(y_true, cap))) as robust_mae from scored, c),
 b as (select PID, y_pred, coalesce(mean_abs_error, (select robust_mae from m)) as band, case when mean_abs_error is null then 'global_robust_mae' else 'neighbourhood_mean_abs_error' end as src
  from scored left join e on scored.NEIGHBOURHOOD_CODE = e.NEIGHBOURHOOD_CODE)
select PID, round(band, 4) as error_band, src as error_band_source, round(greatest(0, y_pred - band), 4) as lower_bound, round(y_pred + band, 4) as upper_bound from b"""
)
def error_band(spark, sf):
    rows = scored(spark, sf)
    before, _ = split(spark, sf)
    metrics = evaluate.regression_metrics(rows, evaluate.target_cap(before, "CURRENT_LAND_VALUE"))
    by_group = evaluate.group_errors(rows, "NEIGHBOURHOOD_CODE").where(F.col("NEIGHBOURHOOD_CODE") != "3")
    out = completion.with_error_band(rows, by_group, metrics, point="y_pred")
    return rounded(out.select("PID", "error_band", "error_band_source", "lower_bound", "upper_bound"))


@query(
    SCORED
    + """select PID, round(greatest(100000.0, y_pred * 0.2), 4) as error_band, 'fallback_20pct' as error_band_source from scored"""
)
def error_band_last_resort(spark, sf):
    rows = scored(spark, sf)
    none = evaluate.group_errors(rows, "NEIGHBOURHOOD_CODE").where(F.lit(False))
    out = completion.with_error_band(rows, none, none.select(), point="y_pred")
    return rounded(out.select("PID", "error_band", "error_band_source"))


@query()
def score_requests(spark, sf):
    bundle, out, before, lookup = trained_model(spark, sf)
    out = train.judged(out, "NEIGHBOURHOOD_CODE")  # predicted once for all errors
    by_group = evaluate.group_errors(out, "NEIGHBOURHOOD_CODE")
    metrics = evaluate.regression_metrics(out, evaluate.target_cap(before, "CURRENT_LAND_VALUE"))
    return scoring.score_requests(scoring_requests(spark, sf), bundle, lookup, by_group, metrics)


@query(
    with_sql(("request", scoring_sql()))
    + "select request_id, concat_ws(',', "
    + ", ".join(f"case when {_absent(c)} then 'missing_{c}' end" for c in _REQUIRED)
    + f", case when not regexp_full_match({_POSTAL}, '[A-Z][0-9][A-Z][0-9][A-Z][0-9]') then 'invalid_postal_code' end) as errors from request where errors <> ''"
)
def refused_requests(spark, sf):
    out = scoring.refused_requests(scoring_requests(spark, sf), 2026)
    return out.select("request_id", F.array_join("errors", ",").alias("errors"))
