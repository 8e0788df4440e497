"""The assessment data model, derived from the driver tables.

Orders joined to customers stand for the yearly extract: the order year plus 25
is the report year, the total price the land value, the nation the
neighbourhood. Some texts are made dirty on purpose, so the cleaning has work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cadastra.plans.clean_fact import clean_fact
from cadastra.plans.model_table import property_features
from cadastra.session import dealt
from registry.core import sql_number, table

YEAR_SHIFT = 25

# Texts with the same meaning in both engines.
RAW_COLUMNS = {
    "PID": "cast(o_orderkey as string)",
    "REPORT_YEAR": "case when o_orderkey % 97 = 5 then 'abc' else cast(year(o_orderdate) + 25 as string) end",
    "NEIGHBOURHOOD_CODE": "case when o_orderkey % 41 = 3 then '' when o_orderkey % 43 = 3 "
    "then concat(' ', c_nationkey, ' ') else cast(c_nationkey as string) end",
    "CURRENT_LAND_VALUE": "case when o_orderkey % 89 = 4 then '1d' when o_orderkey % 83 = 4 then '-5' "
    "when o_orderkey % 79 = 4 then null else cast(o_totalprice as string) end",
    "LEGAL_TYPE": "case when o_orderkey % 53 = 2 then 'None' when o_orderstatus = 'O' then 'STRATA' "
    "when o_orderstatus = 'F' then 'LAND' else 'OTHER' end",
    "ZONING_DISTRICT": "case when o_orderkey % 59 = 2 then 'nan' else o_orderpriority end",
    "ZONING_CLASSIFICATION": "c_mktsegment",
    "PROPERTY_POSTAL_CODE": "case when o_orderkey % 61 = 6 then 'unknown' when o_orderkey % 67 = 6 then null else "
    "concat('v', o_custkey % 10, substr('abceghjklm', cast(1 + o_custkey % 7 as int), 1), ' ', o_orderkey % 3, 'b', o_custkey % 2) end",
    "YEAR_BUILT": "cast(1780 + (o_custkey * 7) % 260 as string)",
    "BIG_IMPROVEMENT_YEAR": "case when o_orderkey % 3 = 0 then null else cast(1950 + o_orderkey % 90 as string) end",
    "LAND_COORDINATE": "case when o_orderkey % 71 = 7 then 'x' else concat(o_custkey, '.5') end",
    "PLAN": "case when o_orderkey % 47 = 8 then 'UNKNOWN' else concat('vap', o_custkey % 50) end",
    "LOT": "cast(o_orderkey % 30 as string)",
}
ADDRESS_COLUMNS = {
    "FROM_CIVIC_NUMBER": "case when o_orderkey % 13 = 1 then null when o_orderkey % 17 = 1 then concat(o_custkey % 400, '.0') "
    "else cast(o_custkey % 400 as string) end",
    "TO_CIVIC_NUMBER": "case when o_orderkey % 3 = 1 then null else cast(o_custkey % 400 + (o_orderkey % 5) * 20 - 10 as string) end",
    "STREET_NAME": "case when o_orderkey % 31 = 9 then '' else concat(o_custkey % 30, 'th-', "
    "case when o_orderkey % 2 = 0 then 'Ave. w' else 'st  e' end) end",
}
SOURCE = "orders join customer on o_custkey = c_custkey"


def _duck(text: str) -> str:
    return text.replace(" as string)", " as varchar)").replace(" as int)", " as integer)")


def _select(cols: dict[str, str]) -> str:
    return ", ".join(f"{_duck(e)} as {n}" for n, e in cols.items())


RAW_SQL = f"select {_select(RAW_COLUMNS)} from {SOURCE}"
ADDRESS_RAW_SQL = f"select o_orderkey as row_id, {_select({**RAW_COLUMNS, **ADDRESS_COLUMNS})} from {SOURCE}"


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = dealt(table(spark, sf_dir, "orders"), "o_orderkey"), table(spark, sf_dir, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey)


def raw_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(spark, sf_dir).select(*[F.expr(e).alias(n) for n, e in RAW_COLUMNS.items()])


def raw_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = {**RAW_COLUMNS, **ADDRESS_COLUMNS}
    return joined(spark, sf_dir).select(F.col("o_orderkey").alias("row_id"), *[F.expr(e).alias(n) for n, e in cols.items()])


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_fact(raw_extract(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return property_features(fact(spark, sf_dir))


def _unknown(c: str) -> str:
    return f"case when {c} is null or trim({c}) in ('', 'nan', 'None', 'NaT') then 'Unknown' else trim({c}) end"


def _code(c: str, squeeze: bool) -> str:
    text = f"upper({_unknown(c)})"
    if squeeze:
        text = f"replace({text}, ' ', '')"
    return f"case when {text} in ('', 'NAN', 'NONE', 'NAT', 'UNKNOWN') then 'Unknown' else {text} end"


def _year(c: str) -> str:
    n = sql_number(c)
    return f"case when ({n}) >= 1800 and ({n}) <= ({sql_number('REPORT_YEAR')}) then ({n}) end"


_CLEAN = f"""
select PID, cast({sql_number('REPORT_YEAR')} as integer) as REPORT_YEAR,
 {_unknown('NEIGHBOURHOOD_CODE')} as NEIGHBOURHOOD_CODE,
 {sql_number('CURRENT_LAND_VALUE')} as CURRENT_LAND_VALUE,
 {_unknown('LEGAL_TYPE')} as LEGAL_TYPE, {_unknown('ZONING_DISTRICT')} as ZONING_DISTRICT,
 {_unknown('ZONING_CLASSIFICATION')} as ZONING_CLASSIFICATION,
 {_code('PROPERTY_POSTAL_CODE', True)} as PROPERTY_POSTAL_CODE,
 {_year('YEAR_BUILT')} as YEAR_BUILT, {_year('BIG_IMPROVEMENT_YEAR')} as BIG_IMPROVEMENT_YEAR,
 {sql_number('LAND_COORDINATE')} as LAND_COORDINATE,
 {_code('PLAN', False)} as PLAN, {_code('LOT', False)} as LOT
from raw_extract
where ({sql_number('CURRENT_LAND_VALUE')}) > 0 and ({sql_number('REPORT_YEAR')}) between 2020 and 2026
"""
FACT_PARTS = [
    ("raw_extract", RAW_SQL),
    (
        "fact",
        f"select *, REPORT_YEAR - YEAR_BUILT as PROPERTY_AGE, REPORT_YEAR - BIG_IMPROVEMENT_YEAR as YEARS_SINCE_IMPROVEMENT from ({_CLEAN})",
    ),
]
_SINCE = "case when REPORT_YEAR - BIG_IMPROVEMENT_YEAR between 0 and 250 then REPORT_YEAR - BIG_IMPROVEMENT_YEAR end"
FEATURE_PARTS = [
    *FACT_PARTS,
    (
        "features",
        f"""
select * exclude (PROPERTY_AGE, YEARS_SINCE_IMPROVEMENT),
 case when REPORT_YEAR - YEAR_BUILT between 0 and 250 then REPORT_YEAR - YEAR_BUILT end as PROPERTY_AGE,
 {_SINCE} as YEARS_SINCE_IMPROVEMENT,
 REPORT_YEAR as REPORT_YEAR_NUM, REPORT_YEAR - 2023 as REPORT_YEAR_CENTERED,
 case when regexp_matches(PROPERTY_POSTAL_CODE, '^[A-Z][0-9][A-Z]') then substr(PROPERTY_POSTAL_CODE, 1, 3) else 'Unknown' end as POSTAL_FSA,
 case when YEAR_BUILT is null then 'unknown' when YEAR_BUILT <= 1949 then 'pre_1950' when YEAR_BUILT <= 1979 then '1950_1979'
  when YEAR_BUILT <= 1999 then '1980_1999' else '2000_plus' end as BUILDING_AGE_BIN,
 cast(BIG_IMPROVEMENT_YEAR is not null as integer) as HAS_BIG_IMPROVEMENT,
 case when ({_SINCE}) is null then 'unknown' when ({_SINCE}) <= 5 then '0_5y' when ({_SINCE}) <= 15 then '6_15y'
  when ({_SINCE}) <= 30 then '16_30y' else '31y_plus' end as IMPROVEMENT_RECENCY_BIN,
 LEGAL_TYPE || '__' || ZONING_CLASSIFICATION as LEGAL_ZONING_COMBO
from fact""",
    ),
]
