"""Cleaning, scalar expressions, filters, reports and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.functions import civic, numbers, postal, text
from cadastra.operators import checks, counts
from cadastra.plans.clean_fact import clean_summary, read_extract, clean_fact as clean
from cadastra.session import shared_folder
from cadastra.sources.delimited import read_columns
from cadastra.sources.sinks import write_table
from registry import standins as st
from registry.core import query, rounded, table, with_sql

FACT = with_sql(*st.FACT_PARTS)
FEATURES = with_sql(*st.FEATURE_PARTS)


def scratch(spark, name: str) -> str:
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(FACT + "select * from fact")
def clean_fact(spark, sf):
    return st.fact(spark, sf)


@query(FACT + "select * from fact")
def clean_fact_from_csv(spark, sf):
    path = scratch(spark, "extract")
    st.raw_extract(spark, sf).write.option("sep", ";").option("header", True).csv(path)
    return clean(read_extract(spark, path))


@query(
    FACT
    + """
, top_n as (select NEIGHBOURHOOD_CODE k, count(*) n from fact group by 1 order by n desc, k limit 20)
, top_p as (select PLAN k, count(*) n from fact group by 1 order by n desc, k limit 20)
select section, metric, round(value, 6) as value from (
 select 'rows' section, 'total_rows_before' metric, cast(count(*) as double) as value from raw_extract
 union all select 'rows', 'total_rows_after', count(*) from fact
 union all select 'missing_rate', 'CURRENT_LAND_VALUE', 0.0
 union all select 'missing_rate', 'YEAR_BUILT', round(avg(cast(YEAR_BUILT is null as double)), 6) from fact
 union all select 'missing_rate', 'BIG_IMPROVEMENT_YEAR', round(avg(cast(BIG_IMPROVEMENT_YEAR is null as double)), 6) from fact
 union all select 'missing_rate', 'LAND_COORDINATE', round(avg(cast(LAND_COORDINATE is null as double)), 6) from fact
 union all select 'missing_rate', c, 0.0 from (values ('PROPERTY_POSTAL_CODE'), ('PLAN'), ('LOT')) v(c)
 union all select 'count_by_report_year', cast(REPORT_YEAR as varchar), count(*) from fact group by REPORT_YEAR
 union all select 'count_by_neighbourhood_code_top20', k, n from top_n
 union all select 'count_by_plan_top20', k, n from top_p
 union all select 'strata_plan_lot_profile', 'strata_rows', count(*) from fact where LEGAL_TYPE = 'STRATA'
 union all select 'strata_plan_lot_profile', 'strata_unique_plan', count(distinct PLAN) from fact where LEGAL_TYPE = 'STRATA'
 union all select 'strata_plan_lot_profile', 'strata_unique_lot', count(distinct LOT) from fact where LEGAL_TYPE = 'STRATA')
"""
)
def clean_fact_summary(spark, sf):
    out = clean_summary(st.raw_extract(spark, sf), st.fact(spark, sf))
    return out.select("section", "metric", F.round(F.col("value").cast("double"), 6).alias("value"))


@query(FEATURES + "select * from features")
def property_features(spark, sf):
    return st.features(spark, sf)


@query(
    FACT
    + """
select 'YEAR_BUILT' as metric, round(avg(cast(YEAR_BUILT is null as double)), 6) as value from fact
union all select 'BIG_IMPROVEMENT_YEAR', round(avg(cast(BIG_IMPROVEMENT_YEAR is null as double)), 6) from fact
union all select 'PROPERTY_AGE', round(avg(cast(PROPERTY_AGE is null as double)), 6) from fact
union all select 'PLAN', round(avg(cast(PLAN is null as double)), 6) from fact"""
)
def null_rates(spark, sf):
    return counts.null_rates(st.fact(spark, sf), ["YEAR_BUILT", "BIG_IMPROVEMENT_YEAR", "PROPERTY_AGE", "PLAN"], 6)


@query("select p_brand, count(*) as count from part group by 1 order by count desc, p_brand limit 20")
def top_value_counts(spark, sf):
    return counts.top_values(table(spark, sf, "part"), "p_brand", 20)


@query(
    "select p_type, p_name, count(*) as count, cast(row_number() over (partition by p_type order by count(*) desc, p_name) as integer) as rank "
    "from part group by 1, 2 qualify rank <= 3"
)
def top_values_per_group(spark, sf):
    return counts.top_values_per_group(table(spark, sf, "part"), ["p_type"], "p_name", 3)


@query("select nullif(p_size % 5, 2) as size_class, count(*) as count from part group by 1")
def value_counts_with_null(spark, sf):
    part = table(spark, sf, "part").select(F.expr("nullif(p_size % 5, 2)").alias("size_class"))
    return counts.value_counts(part, "size_class")


@query(
    FACT + "select LEGAL_TYPE, mode from (select LEGAL_TYPE, PLAN as mode, row_number() over "
    "(partition by LEGAL_TYPE order by count(*) desc, PLAN) r from fact group by LEGAL_TYPE, PLAN) where r = 1"
)
def most_frequent_per_group(spark, sf):
    return counts.most_frequent(st.fact(spark, sf), ["LEGAL_TYPE"], "PLAN")


@query(FACT + "select count(distinct PLAN) as PLAN, count(distinct LOT) as LOT from fact where upper(LEGAL_TYPE) = 'STRATA'")
def strata_distinct_counts(spark, sf):
    return counts.distinct_count(st.fact(spark, sf).where(F.upper("LEGAL_TYPE") == "STRATA"), ["PLAN", "LOT"])


@query(
    FACT
    + "select cast(min(REPORT_YEAR) as integer) as min_year, cast(max(REPORT_YEAR) as integer) as max_year, 2026 as default_report_year from fact"
)
def service_facts(spark, sf):
    from cadastra.plans.scoring import service_facts as facts

    return facts(st.fact(spark, sf), 2026)


@query(FACT + "select count(*) filter (where REPORT_YEAR < 2024) as train_rows, count(*) filter (where REPORT_YEAR >= 2024) as test_rows from fact")
def time_split_counts(spark, sf):
    return checks.split_counts(st.fact(spark, sf), "REPORT_YEAR", 2024)


@query("select o_custkey, count(*) as rows from orders group by 1 having count(*) > 1")
def duplicate_join_keys(spark, sf):
    return checks.duplicate_keys(table(spark, sf, "orders"), ["o_custkey"])


@query(
    FACT
    + """select section, metric, value from (select 'table' as section, 'year_coverage' as metric, min(REPORT_YEAR) || '-' || max(REPORT_YEAR) as value from fact
 union all select 'table', 'years', string_agg(y, ',' order by y) from (select distinct cast(REPORT_YEAR as varchar) y from fact))"""
)
def year_coverage(spark, sf):
    years = F.array_sort(F.collect_set("REPORT_YEAR"))
    wide = st.fact(spark, sf).agg(
        F.concat_ws("-", F.min("REPORT_YEAR"), F.max("REPORT_YEAR")).alias("year_coverage"),
        F.array_join(years, ",").alias("years"),
    )
    return counts.wide_to_summary(wide, "table")


@query(
    "select p_brand, round(sum(p_retailprice), 4) as total, round(sum(p_retailprice) / sum(sum(p_retailprice)) over (), 8) as share "
    "from part group by 1"
)
def share_of_total(spark, sf):
    out = counts.share_of_total(table(spark, sf, "part"), "p_brand", "p_retailprice", "total", "share")
    return out.select("p_brand", F.round("total", 4).alias("total"), F.round("share", 8).alias("share"))


@query(
    r"""select doc_id,
 trim(regexp_replace(regexp_replace(upper(replace(text, 'ß', 'ss')), '[^A-Z0-9\s]|\s', ' ', 'g'), ' +', ' ', 'g')) as street,
 lower(lang) || '__' || source as pair,
 starts_with(source, 'src1') as by_prefix, contains(text, 'the') as by_text, regexp_matches(text, '[0-9]{3}') as by_pattern,
 lang in ('en', 'fr') as by_member, n_chars between 100 and 1000 as by_range, length(trim(text)) > 0 as has_text
from documents"""
)
def text_expressions(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(
        "doc_id",
        text.street_name("text").alias("street"),
        text.pair_key(text.fold("lang"), "source").alias("pair"),
        F.col("source").startswith("src1").alias("by_prefix"),
        F.col("text").contains("the").alias("by_text"),
        F.col("text").rlike("[0-9]{3}").alias("by_pattern"),
        F.col("lang").isin("en", "fr").alias("by_member"),
        F.col("n_chars").between(100, 1000).alias("by_range"),
        (F.length(text.strip_ws("text")) > 0).alias("has_text"),
    )


@query(
    r"""select doc_id, nullif(upper(regexp_replace(regexp_extract(text, '\b([A-Za-z]\d[A-Za-z][ -]?\d[A-Za-z]\d)\b', 1), '[ -]', '', 'g')), '') as postal
from (select doc_id, text || ' v' || (doc_id % 10) || 'b-1a' || (doc_id % 7) || '.' as text from documents)"""
)
def postal_in_text(spark, sf):
    docs = table(spark, sf, "documents").withColumn(
        "text", F.expr("concat(text, ' v', doc_id % 10, 'b-1a', doc_id % 7, '.')")
    )
    return docs.select("doc_id", postal.postal_in_text("text").alias("postal"))


@query(
    r"""select p_partkey,
 replace(replace(upper(trim(code)), ' ', ''), '-', '') as lookup_code, substr(replace(replace(upper(trim(code)), ' ', ''), '-', ''), 1, 3) as lookup_fsa,
 replace(upper(code), ' ', '') as stored, regexp_full_match(replace(upper(code), ' ', ''), '[A-Z][0-9][A-Z][0-9][A-Z][0-9]') as valid,
 case when p_partkey % 5 = 0 then 'Unknown' else brand end as category
from (select p_partkey, 'v' || (p_size % 10) || case when p_size % 4 = 0 then '-' else 'k ' end || '1a' || (p_partkey % 10) as code,
 trim(case when p_partkey % 5 = 0 then ' NaN ' else ' ' || p_brand || ' ' end) as brand from part)"""
)
def postal_and_category_expressions(spark, sf):
    part = table(spark, sf, "part").select(
        "p_partkey",
        F.expr("concat('v', p_size % 10, case when p_size % 4 = 0 then '-' else 'k ' end, '1a', p_partkey % 10)").alias("code"),
        F.expr("case when p_partkey % 5 = 0 then ' NaN ' else concat(' ', p_brand, ' ') end").alias("brand"),
    )
    return part.select(
        "p_partkey",
        postal.lookup_postal("code").alias("lookup_code"),
        postal.lookup_fsa("code").alias("lookup_fsa"),
        postal.postal_code("code").alias("stored"),
        postal.is_valid_postal("code").alias("valid"),
        text.category("brand").alias("category"),
    )


@query(
    """select l_orderkey, l_partkey, l_suppkey, l_linenumber,
 case when l_linenumber = 3 then null else l_extendedprice end as number,
 case when l_quantity <= 10 then 'small' when l_quantity <= 30 then 'medium' else 'large' end as bin,
 case when l_quantity between 5 and 45 then l_quantity end as inside,
 cast(floor(l_extendedprice) as integer) as whole from lineitem"""
)
def number_expressions(spark, sf):
    line = table(spark, sf, "lineitem").withColumn(
        "shown", F.when(F.col("l_linenumber") == 3, F.lit("..")).otherwise(F.col("l_extendedprice").cast("string"))
    )
    return line.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        numbers.footnoted_number("shown").alias("number"),
        numbers.bin_right_closed("l_quantity", [10, 30], ["small", "medium", "large"]).alias("bin"),
        numbers.null_outside("l_quantity", 5, 45).alias("inside"),
        numbers.to_year(F.col("l_extendedprice")).alias("whole"),
    )


_CIVIC = r"regexp_replace(coalesce({c}, ''), '^(\d+)\.0+$', '\1')"
_FROM, _TO = _CIVIC.format(c="FROM_CIVIC_NUMBER"), _CIVIC.format(c="TO_CIVIC_NUMBER")
ADDRESS_PARTS = [
    ("raw_address", st.ADDRESS_RAW_SQL),
    (
        "address",
        rf"""select row_id as ROW_ID, cast(REPORT_YEAR as integer) as REPORT_YEAR, cast(YEAR_BUILT as integer) as YEAR_BUILT,
 cast(BIG_IMPROVEMENT_YEAR as integer) as BIG_IMPROVEMENT_YEAR, trim(PROPERTY_POSTAL_CODE) as PROPERTY_POSTAL_CODE, trim(STREET_NAME) as STREET_NAME,
 LEGAL_TYPE, ZONING_DISTRICT, ZONING_CLASSIFICATION, trim(NEIGHBOURHOOD_CODE) as NEIGHBOURHOOD_CODE,
 {_FROM} as FROM_CIVIC_NUMBER, {_TO} as TO_CIVIC_NUMBER,
 replace(upper(PROPERTY_POSTAL_CODE), ' ', '') as POSTAL_CODE_NORMALIZED, substr(replace(upper(PROPERTY_POSTAL_CODE), ' ', ''), 1, 3) as POSTAL_FSA,
 trim(regexp_replace(regexp_replace(upper(STREET_NAME), '[^A-Z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) as STREET_NAME_NORMALIZED,
 least(try_cast(nullif(regexp_extract({_FROM}, '^(\d+)', 1), '') as bigint), try_cast(nullif(regexp_extract({_TO}, '^(\d+)', 1), '') as bigint)) as CIVIC_LOW,
 greatest(try_cast(nullif(regexp_extract({_FROM}, '^(\d+)', 1), '') as bigint), try_cast(nullif(regexp_extract({_TO}, '^(\d+)', 1), '') as bigint)) as CIVIC_HIGH,
 case when {_FROM} <> '' and {_TO} <> '' then case when {_FROM} = {_TO} then {_FROM} else {_FROM} || '-' || {_TO} end
  else {_FROM} || {_TO} end || ' ' || trim(STREET_NAME) || ', ' || trim(PROPERTY_POSTAL_CODE) as DISPLAY_ADDRESS
from raw_address where REPORT_YEAR <> 'abc' and PROPERTY_POSTAL_CODE is not null and STREET_NAME <> ''
 and (FROM_CIVIC_NUMBER is not null or TO_CIVIC_NUMBER is not null)""",
    ),
]


@query(with_sql(*ADDRESS_PARTS) + "select * from address")
def address_table(spark, sf):
    from cadastra.operators.addresses import address_table as addresses

    return addresses(st.raw_addresses(spark, sf), "row_id")


@query(with_sql(("raw_address", st.ADDRESS_RAW_SQL)) + "select PID, STREET_NAME, cast(null as varchar) as UNIT from raw_address")
def pruned_csv_columns(spark, sf):
    path = scratch(spark, "addresses")
    st.raw_addresses(spark, sf).write.option("sep", ";").option("header", True).option("emptyValue", "").csv(path)
    out = read_columns(spark, path, ["PID", "STREET_NAME"], ["UNIT"], sep=";")
    return out.withColumn("STREET_NAME", F.coalesce("STREET_NAME", F.lit("")))


@query(FACT + "select REPORT_YEAR, PID, CURRENT_LAND_VALUE from fact where REPORT_YEAR = 2022")
def partitioned_table_one_year(spark, sf):
    path = scratch(spark, "fact")
    write_table(st.fact(spark, sf), path, ["REPORT_YEAR"])
    return spark.read.parquet(path).where(F.col("REPORT_YEAR") == 2022).select("REPORT_YEAR", "PID", "CURRENT_LAND_VALUE")


@query(
    r"""select row_id, civic, try_cast(nullif(regexp_extract(civic, '^(\d+)', 1), '') as bigint) as leading from
 (select row_id, regexp_replace(coalesce(FROM_CIVIC_NUMBER, ''), '^(\d+)\.0+$', '\1') as civic from (""" + st.ADDRESS_RAW_SQL + "))"
)
def civic_numbers(spark, sf):
    raw = st.raw_addresses(spark, sf)
    return raw.select(
        "row_id", civic.civic_number("FROM_CIVIC_NUMBER").alias("civic"), civic.civic_int("FROM_CIVIC_NUMBER").alias("leading")
    )
