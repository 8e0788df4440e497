"""External yearly series, census profile, history and the model table."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from cadastra.functions.numbers import month_label_date
from cadastra.operators import history as hist
from cadastra.operators import yearly
from cadastra.plans import model_table as mt
from cadastra.sources import census, monthly, sheets
from cadastra.sources.delimited import read_columns
from cadastra.session import stage
from cadastra.sources.workbook import workbook_cells
from registry import standins as st
from registry.cleaning import FACT, scratch
from registry.core import query, rounded, table, with_sql


def ship_months(spark, sf):
    """Mean discount per month of the line items: a monthly rate."""
    month = F.trunc(F.col("l_shipdate").cast("date"), "month")
    rate = F.round(F.avg("l_discount"), 6)
    return table(spark, sf, "lineitem").groupBy(month.alias("date")).agg(rate.alias("value"))


MONTHS = "months as (select date_trunc('month', l_shipdate) as d, round(avg(l_discount), 6) as v from lineitem group by 1)"
YEARLY = (
    "select cast(year(d) as integer) as REPORT_YEAR, round(avg(v), 4) as rate_avg, round(arg_max(v, d), 4) as rate_end_of_year "
)


@query(f"with {MONTHS} {YEARLY} from months group by 1")
def yearly_from_monthly(spark, sf):
    return rounded(
        yearly.yearly_from_monthly(ship_months(spark, sf), "date", "value", "rate_avg", "rate_end_of_year", "REPORT_YEAR")
    )


@query(
    "select l_returnflag, cast(date_trunc('month', l_shipdate) as date) as date, round(avg(l_discount), 6) as value from lineitem group by 1, 2"
)
def months_wide_to_long(spark, sf):
    label = F.date_format("l_shipdate", "MMMM yyyy")
    wide = (
        table(spark, sf, "lineitem")
        .withColumn("label", label)
        .groupBy("l_returnflag")
        .pivot("label")
        .agg(F.round(F.avg("l_discount"), 6))
    )
    long = monthly.melt_months(wide, ["l_returnflag"])
    out = long.select("l_returnflag", month_label_date("month_label").alias("date"), "value")
    return out.where(F.col("value").isNotNull())


@query(
    "with months as (select s_nationkey, date_trunc('month', l_shipdate) as d, round(avg(l_discount), 6) as v "
    f"from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2) {YEARLY} from months where s_nationkey = 3 group by 1"
)
def monthly_csv_with_preamble(spark, sf):
    """One line per nation under a header that has to be found."""
    line, supplier = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    rates = (
        line.join(supplier, line.l_suppkey == supplier.s_suppkey)
        .groupBy(F.concat(F.lit("NATION_"), F.col("s_nationkey")).alias("area"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("d"))
        .agg(F.round(F.avg("l_discount"), 6).alias("v"))
    )
    months = rates.agg(F.array_sort(F.collect_set("d")).alias("all"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    labels = F.array_join(F.transform("all", lambda d: quoted(F.date_format(d, "MMMM yyyy"))), ",")
    header = months.select(F.lit(2).alias("n"), F.concat(F.lit('"Geography","January 1951",'), labels).alias("line"))
    known = F.map_from_entries(F.collect_list(F.struct("d", F.col("v").cast("string"))))
    cells = rates.groupBy("area").agg(known.alias("known")).withColumn("all", months.scalar())
    values = F.transform("all", lambda d: F.coalesce(F.try_element_at("known", d), F.lit("")))
    rows = cells.select(F.lit(3).alias("n"), F.concat(quoted(F.col("area")), F.lit(",,"), F.array_join(values, ",")).alias("line"))
    title = months.select(F.lit(1).alias("n"), F.concat(F.lit('"Rates, months: '), F.size("all"), F.lit('"')).alias("line"))
    path = scratch(spark, "monthly")
    lines = title.unionByName(header).unionByName(rows)
    lines.coalesce(1).sortWithinPartitions("n", "line").select("line").write.text(path)
    rates_of_area = monthly.read_monthly(spark, path, "NATION_3")
    return rounded(
        yearly.yearly_from_monthly(rates_of_area, "date", "value", "rate_avg", "rate_end_of_year", "REPORT_YEAR")
    )


SUPPLY_SQL = """select cast(year(l_shipdate) as integer) as REPORT_YEAR, round(sum(l_quantity), 4) as net, cast(count(*) as double) as added,
 round(avg(l_discount), 4) as converted from lineitem group by 1"""


def supply(spark, sf):
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.year("l_shipdate").alias("Year"))
        .agg(
            F.round(F.sum("l_quantity"), 4).alias("net_change_total"),
            F.count(F.lit(1)).cast("double").alias("new_added"),
            F.round(F.avg("l_discount"), 4).alias("existing_converted"),
        )
    )


@query(SUPPLY_SQL)
def yearly_csv_passthrough(spark, sf):
    path = scratch(spark, "supply")
    supply(spark, sf).write.option("header", True).csv(path)
    required = ["Year", "net_change_total", "new_added", "existing_converted"]
    raw = read_columns(spark, path, required, what="supply table")
    names = {"net_change_total": "net", "new_added": "added", "existing_converted": "converted"}
    return yearly.yearly_passthrough(raw, "Year", "REPORT_YEAR", names)


_LAGS = """select REPORT_YEAR, net, lag(net) over w as net_lag1, net - lag(net) over w as net_yoy_change,
 converted, lag(converted) over w as converted_lag1, round(converted - lag(converted) over w, 4) as converted_yoy_change
 from s window w as (order by REPORT_YEAR)"""


def supply_series(spark, sf, shift: int = 0):
    names = {"net_change_total": "net", "existing_converted": "converted"}
    series = yearly.yearly_passthrough(supply(spark, sf), "Year", "REPORT_YEAR", names)
    return series.withColumn("REPORT_YEAR", F.col("REPORT_YEAR") + shift)


@query(f"with s as ({SUPPLY_SQL}) {_LAGS}")
def yearly_lag_and_change(spark, sf):
    series, status = yearly.prepare_yearly(supply_series(spark, sf), "REPORT_YEAR")
    assert status == "merged"
    return rounded(series)


@query(
    "select cast(year(o_orderdate) as integer) as REPORT_YEAR, max_by(o_totalprice, struct_pack(a := o_orderdate, b := o_orderkey)) as last_value from orders group by 1"
)
def last_row_per_year(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.year("o_orderdate").alias("REPORT_YEAR"), "o_orderdate", "o_orderkey", F.col("o_totalprice").alias("last_value")
    )
    return yearly.last_per_year(orders, "REPORT_YEAR", ["last_value"], ["o_orderdate", "o_orderkey"])


@query(
    FACT
    + f""", s0 as ({SUPPLY_SQL}), s1 as (select REPORT_YEAR + 25 as REPORT_YEAR, net, converted from s0), s as ({_LAGS.replace(' from s ', ' from s1 ')}),
 s2 as ({_LAGS.replace(' from s ', ' from s0 ').replace('REPORT_YEAR,', 'REPORT_YEAR + 27 as REPORT_YEAR,', 1)})
select f.PID, f.REPORT_YEAR, s.net, s.net_lag1, s.net_yoy_change, s.converted, s.converted_lag1, s.converted_yoy_change,
 s2.net as late_net, s2.net_lag1 as late_net_lag1, s2.net_yoy_change as late_net_yoy_change, s2.converted as late_converted,
 s2.converted_lag1 as late_converted_lag1, s2.converted_yoy_change as late_converted_yoy_change
from fact f left join s on f.REPORT_YEAR = s.REPORT_YEAR left join s2 on f.REPORT_YEAR = s2.REPORT_YEAR"""
)
def merge_yearly_series(spark, sf):
    late = supply_series(spark, sf, 27).withColumnsRenamed({"net": "late_net", "converted": "late_converted"})
    sources = {"supply": supply_series(spark, sf, 25), "late": late, "absent": None}
    out, cols, _ = yearly.merge_yearly(st.fact(spark, sf).select("PID", "REPORT_YEAR"), sources, "REPORT_YEAR")
    return rounded(out)


@query(
    f"""with s as ({SUPPLY_SQL})
select 'supply' as source, case when count(REPORT_YEAR) = 0 then 'missing_REPORT_YEAR' when count(net) + count(added) + count(converted) > 0 then 'merged' else 'no_numeric_features' end as status from s
union all select 'absent', case when count(*) = 0 then 'missing_input' end from duckdb_tables() where table_name = 'no_such_series'
union all select 'no_year', case when count(*) filter (column_name = 'REPORT_YEAR') = 0 then 'missing_REPORT_YEAR' end from duckdb_columns() where table_name = 'region'
union all select 'texts', case when count(try_cast(o_orderstatus as double)) > 0 then 'merged' else 'no_numeric_features' end from orders"""
)
def yearly_source_status(spark, sf):
    supply_table = supply_series(spark, sf)
    texts = table(spark, sf, "orders").select(F.year("o_orderdate").alias("REPORT_YEAR"), "o_orderstatus")
    sources = {"supply": supply_table, "absent": None, "no_year": table(spark, sf, "region"), "texts": texts}
    rows = [(name, yearly.prepare_yearly(df, "REPORT_YEAR")[1]) for name, df in sources.items()]
    return spark.createDataFrame(rows, "source string, status string")


SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def workbook_bytes(rows: list[list[str]], sheet: str) -> bytes:
    """A small workbook: texts are shared strings, numbers are plain values."""
    texts: dict[str, int] = {}

    def cell(row: int, col: int, value: str) -> str:
        ref = f"{chr(65 + col)}{row + 1}"
        if value.replace(".", "", 1).isdigit():
            return f'<c r="{ref}"><v>{value}</v></c>'
        return f'<c r="{ref}" t="s"><v>{texts.setdefault(value, len(texts))}</v></c>'

    body = "".join(
        f'<row r="{i + 1}">' + "".join(cell(i, j, v) for j, v in enumerate(row) if v) + "</row>" for i, row in enumerate(rows)
    )
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{SHEET}" xmlns:r="{OFFICE}"><sheets><sheet name="{sheet}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{SHEET}"><sheetData>{body}</sheetData></worksheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{SHEET}">' + "".join(f"<si><t>{t}</t></si>" for t in texts) + "</sst>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)
    return out.getvalue()


def nation_workbooks(spark, sf):
    """One workbook per nation: orders and customers of the nation by year."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("year")
        heads = ["Area", "City", *[f"{y} Total" for y in pdf["year"]]]
        city = ["", "Vancouver", *[str(n) for n in pdf["orders"]]]
        total = ["British Columbia Total", "", *[str(n) for n in pdf["buyers"]]]
        rows = [["Title"], heads, ["x", "Elsewhere", "1"], city, total]
        key = int(pdf["c_nationkey"].iloc[0])
        return pd.DataFrame({"path": [f"nation-{key}.xlsx"], "content": [workbook_bytes(rows, "PR - CMA")]})

    counted = (
        st.joined(spark, sf)
        .groupBy("c_nationkey", (F.year("o_orderdate") + 25).alias("year"))
        .agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("o_custkey").alias("buyers"))
    )
    return counted.groupBy("c_nationkey").applyInPandas(build, "path string, content binary")


@query(
    f"""select 'nation-' || c_nationkey || '.xlsx' as path, 'PR - CMA' as sheet, cast(year(o_orderdate) + 25 as integer) as REPORT_YEAR,
 cast(count(*) as double) as ircc_pr_vancouver_cma, cast(count(distinct o_custkey) as double) as ircc_pr_bc_total from {st.SOURCE} group by c_nationkey, 3"""
)
def yearly_from_workbooks(spark, sf):
    cells = workbook_cells(nation_workbooks(spark, sf), "PR - CMA")
    return sheets.yearly_from_sheet(cells, sheets.PERMANENT_RESIDENT_ROWS, "REPORT_YEAR")


@query(
    f"""select 'nation-' || c_nationkey || '.xlsx' as path, cast(4 + 0 * count(*) as bigint) as full_rows,
 cast(2 * count(distinct year(o_orderdate)) + 3 + 3 + 2 + count(distinct year(o_orderdate)) - count(distinct year(o_orderdate)) as bigint) as cells
 from {st.SOURCE} group by 1"""
)
def workbook_cell_table(spark, sf):
    cells = workbook_cells(nation_workbooks(spark, sf))
    return cells.groupBy("path").agg(
        (F.count_distinct("row_idx") - 1).alias("full_rows"),
        (F.count(F.lit(1)) - F.count_if(F.col("value").rlike("Total$")) + 1).alias("cells"),
    )


CENSUS_SQL = """
with rows_ as (
 select n_nationkey, n_name, r_name, count(*) as people, round(avg(c_acctbal), 1) as size_, round(median(c_acctbal), 2) as income,
  count(*) filter (where c_acctbal >= 5000) as owners, count(*) filter (where c_acctbal < 5000) as renters,
  round(100.0 * count(*) filter (where c_acctbal < 0) / count(*), 2) as older
 from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2, 3)
select 2021 as CENSUS_YEAR, case when n_nationkey % 2 = 0 then '2021S05' else '2021A' end || n_nationkey as DGUID, n_name as GEO_NAME,
 case when n_nationkey % 2 = 0 then 'vancouver_cma' else 'vancouver_csd' end as geo_scope, cast(people as double) as census_population_2021,
 size_ as census_avg_household_size, income as census_median_household_income_2020, cast(owners as double) as census_owner_households,
 cast(renters as double) as census_renter_households, older as census_age_65_plus_pct from rows_"""


@query(CENSUS_SQL + " where r_name in ('ASIA', 'EUROPE')")
def census_profile_by_area(spark, sf):
    """Long characteristic rows of all nations; the profile of the nations of two regions."""
    customer, nation, region = (table(spark, sf, n) for n in ("customer", "nation", "region"))
    named = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    code = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "2021S05").otherwise("2021A"), F.col("n_nationkey"))
    wide = named.groupBy(code.alias("DGUID"), "n_name").agg(
        F.count(F.lit(1)).alias("people"),
        F.round(F.avg("c_acctbal"), 1).alias("size"),
        F.round(F.percentile("c_acctbal", F.lit(0.5)), 2).alias("income"),
        F.count_if(F.col("c_acctbal") >= 5000).alias("owners"),
        F.count_if(F.col("c_acctbal") < 5000).alias("renters"),
        F.round(100.0 * F.count_if(F.col("c_acctbal") < 0) / F.count(F.lit(1)), 2).alias("older"),
    )
    text = lambda c: F.col(c).cast("string")
    lines = [
        (1, "Population, 2021", text("people"), F.lit("")),
        (2, "  Average household size", F.lit(".."), F.lit("")),
        (3, "  Average household size", text("size"), F.lit("")),
        (4, "Median total income of household in 2020 ($)", text("income"), F.lit("")),
        (5, "  Owner", text("owners"), F.lit("")),
        (6, "  Renter", text("renters"), F.lit("")),
        (7, "65 years and over", text("people"), F.lit("250")),
        (8, "65 years and over", F.lit("..."), text("older")),
    ]
    row = lambda i, n, c, r: F.struct(
        F.lit(str(i)).alias("CHARACTERISTIC_ID"), F.lit(n).alias("CHARACTERISTIC_NAME"), c.alias("C1_COUNT_TOTAL"), r.alias("C10_RATE_TOTAL")
    )
    long = wide.select("DGUID", F.col("n_name").alias("GEO_NAME"), F.explode(F.array(*[row(*x) for x in lines])).alias("c"))
    long = long.select(F.lit("2021").alias("CENSUS_YEAR"), "DGUID", F.lit("CMA").alias("GEO_LEVEL"), "GEO_NAME", "c.*")
    path = scratch(spark, "census")
    long.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    scope = F.when(F.col("DGUID").startswith("2021S05"), "vancouver_cma").otherwise("vancouver_csd")
    targets = named.where(F.col("r_name").isin("ASIA", "EUROPE")).select(code.alias("DGUID"), F.col("n_name").alias("GEO_NAME")).distinct()
    return census.profile_by_geo(census.read_profile(spark, path), targets.withColumn("geo_scope", scope), census.CENSUS_RULES)


@query(
    "select case when n_nationkey % 2 = 0 then '2021S05' else '2021A' end || min(n_nationkey) as DGUID, 'AREA' as GEO_NAME, "
    "case when n_nationkey % 2 = 0 then 'vancouver_cma' else 'vancouver_csd' end as geo_scope from (select * from nation where n_nationkey < 10) group by n_nationkey % 2"
)
def target_areas(spark, sf):
    code = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "2021S05").otherwise("2021A"), F.col("n_nationkey"))
    name = F.when(F.col("n_nationkey") < 10, F.lit(" Area ")).otherwise(F.lit("Elsewhere"))
    geo = table(spark, sf, "nation").select(name.alias("Geo Name"), code.alias("Geo Code"))
    return census.target_areas(geo, "area").withColumn("GEO_NAME", F.upper("GEO_NAME"))


def history_sql(source: str, year: str, group: str, target: str, prefix: str, extended: bool, keep_growth: bool = True) -> str:
    m = "land_value"
    cols = [
        f"lag(med) over w as {prefix}_prev_year_median_{m}",
        f"round(lag(mean_) over w + 1e-7, 4) as {prefix}_prev_year_mean_{m}",
        f"lag(n) over w as {prefix}_prev_year_property_count",
        f"lag(med, 2) over w as {prefix}_prev_2yr_median_{m}",
        f"case when count(med) over r >= 2 then quantile_cont(med, 0.5) over r end as {prefix}_prev_3yr_rolling_median_{m}",
        f"case when count(med) over r = 3 then round(regr_slope(med, i) over r, 4) end as {prefix}_prev_3yr_growth_trend",
    ]
    if keep_growth:
        cols.append(f"round(lag(med) over w / nullif(lag(med, 2) over w, 0) - 1, 6) as {prefix}_prev_year_growth_rate")
    if extended:
        cols += [
            f"round(lag(mean_, 2) over w + 1e-7, 4) as {prefix}_prev_2yr_mean_{m}",
            f"case when count(med) over r >= 2 then round(avg(med) over r, 4) end as {prefix}_prev_3yr_rolling_mean_{m}",
            f"case when count(med) over r >= 2 then round(stddev_samp(med) over r, 4) end as {prefix}_prev_3yr_value_std",
        ]
    cols = [c if c.startswith("round") or "round(" in c else f"round({c.rsplit(' as ', 1)[0]}, 4) as {c.rsplit(' as ', 1)[1]}" for c in cols]
    cols = [c.replace("round(lag(n) over w, 4)", "lag(n) over w") for c in cols]
    return f"""select {year}, {group}, {', '.join(cols)} from (select *, row_number() over (partition by {group} order by {year}) as i
 from (select {year}, {group}, quantile_cont({target}, 0.5) as med, avg({target}) as mean_, count({target}) as n from {source} group by 1, 2))
 window w as (partition by {group} order by {year}), r as (partition by {group} order by {year} rows between 3 preceding and 1 preceding)"""


def rounded_history(df):
    """Rates to 6 digits, the rest to 4; means are nudged off the exact ties of small groups."""
    fixed = {c: F.round(F.col(c) + 1e-7, 4) for c in df.columns if "year_mean" in c or "2yr_mean" in c}
    rates = [c for c in df.columns if c.endswith("growth_rate")]
    kept = df.withColumns({**fixed, **{c: F.round(c, 6).cast("decimal(30,6)") for c in rates}})
    return rounded(kept).withColumns({c: F.col(c).cast("double") for c in rates})


@query(FACT + history_sql("fact", "REPORT_YEAR", "NEIGHBOURHOOD_CODE", "CURRENT_LAND_VALUE", "neigh", True))
def group_history_extended(spark, sf):
    fact = st.fact(spark, sf)
    return rounded_history(hist.group_history(fact, "REPORT_YEAR", "NEIGHBOURHOOD_CODE", "CURRENT_LAND_VALUE", "neigh", True))


@query(
    with_sql(*st.FEATURE_PARTS, ("h", history_sql("features", "REPORT_YEAR", "POSTAL_FSA", "CURRENT_LAND_VALUE", "fsa", False)))
    + "select * from (select PID, REPORT_YEAR, POSTAL_FSA, CURRENT_LAND_VALUE from features) left join h using (REPORT_YEAR, POSTAL_FSA)"
)
def group_history_joined_to_facts(spark, sf):
    facts = st.features(spark, sf).select("PID", "REPORT_YEAR", "POSTAL_FSA", "CURRENT_LAND_VALUE")
    history = hist.group_history(facts, "REPORT_YEAR", "POSTAL_FSA", "CURRENT_LAND_VALUE", "fsa")
    return rounded_history(hist.attach_history(facts, history, "REPORT_YEAR", "POSTAL_FSA"))


@query(
    "with base as (select cast(year(o_orderdate) as integer) as y, cast(o_custkey as varchar) as k, o_totalprice from orders) "
    + history_sql("base", "y", "k", "o_totalprice", "cust", False)
)
def group_history_sparse(spark, sf):
    """Many small groups with missing years: "previous" is the previous observed year."""
    orders = table(spark, sf, "orders").select(
        F.year("o_orderdate").alias("y"), F.col("o_custkey").cast("string").alias("k"), "o_totalprice"
    )
    return rounded_history(hist.group_history(orders, "y", "k", "o_totalprice", "cust"))


@query(
    """with s as (select cast(year(o_orderdate) as integer) as y, cast(o_custkey as varchar) as k, quantile_cont(o_totalprice, 0.5) as med, avg(o_totalprice) as mean_,
 count(*) as n from orders group by 1, 2)
select s.y, s.k, round(a.med, 4) as cust_prev_year_median_land_value, round(a.mean_ + 1e-7, 4) as cust_prev_year_mean_land_value, a.n as cust_prev_year_property_count,
 round(a.med / b.med - 1, 6) as cust_prev_year_growth_rate, round(b.med, 4) as cust_prev_2yr_median_land_value
from s left join s a on s.k = a.k and s.y = a.y + 1 left join s b on s.k = b.k and s.y = b.y + 2"""
)
def group_history_strict_years(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.year("o_orderdate").alias("y"), F.col("o_custkey").cast("string").alias("k"), "o_totalprice"
    )
    keep = hist.history_names("cust", "land_value", False)[:5]
    return rounded_history(hist.group_history(orders, "y", "k", "o_totalprice", "cust", keep=keep, strict_year=True))


@query(
    """with s as (select cast(year(o_orderdate) as integer) as y, cast(o_custkey as varchar) as k, quantile_cont(o_totalprice, 0.5) as med, avg(o_totalprice) as mean_,
 count(*) as n from orders group by 1, 2)
select s.y, s.k, round(a.med, 4) as cust_prev_year_median_land_value, round(a.mean_ + 1e-7, 4) as cust_prev_year_mean_land_value, a.n as cust_prev_year_property_count,
 round(a.med / b.med - 1, 6) as cust_prev_year_growth_rate, round(b.med, 4) as cust_prev_2yr_median_land_value, round(b.mean_ + 1e-7, 4) as cust_prev_2yr_mean_land_value,
 case when (a.med is not null)::int + (b.med is not null)::int + (c.med is not null)::int >= 2
  then round(list_median([x for x in [a.med, b.med, c.med] if x is not null]), 4) end as cust_prev_3yr_rolling_median_land_value,
 case when (a.med is not null)::int + (b.med is not null)::int + (c.med is not null)::int >= 2
  then round(list_avg([x for x in [a.med, b.med, c.med] if x is not null]), 4) end as cust_prev_3yr_rolling_mean_land_value,
 case when b.med is not null then round((a.med - c.med) / 2, 4) end as cust_prev_3yr_growth_trend,
 case when (a.med is not null)::int + (b.med is not null)::int + (c.med is not null)::int >= 2
  then round(list_stddev_samp([x for x in [a.med, b.med, c.med] if x is not null]), 4) end as cust_prev_3yr_value_std
from s left join s a on s.k = a.k and s.y = a.y + 1 left join s b on s.k = b.k and s.y = b.y + 2 left join s c on s.k = c.k and s.y = c.y + 3"""
)
def group_history_strict_years_all(spark, sf):
    """``group_history_strict_years`` has the columns of its SQL; this has all."""
    orders = table(spark, sf, "orders").select(
        F.year("o_orderdate").alias("y"), F.col("o_custkey").cast("string").alias("k"), "o_totalprice"
    )
    return rounded_history(hist.group_history(orders, "y", "k", "o_totalprice", "cust", True, strict_year=True))


def plain_history_sql(group: str, prefix: str, extended: bool) -> str:
    """``history_sql`` of the features without any rounding, for tables that are worked on."""
    m = "land_value"
    seen = "count(med) over r"
    cols = {
        f"prev_year_median_{m}": "lag(med) over w", f"prev_year_mean_{m}": "lag(mean_) over w", "prev_year_property_count": "lag(n) over w",
        f"prev_2yr_median_{m}": "lag(med, 2) over w", f"prev_3yr_rolling_median_{m}": f"case when {seen} >= 2 then quantile_cont(med, 0.5) over r end",
        "prev_3yr_growth_trend": f"case when {seen} = 3 then regr_slope(med, i) over r end",
    }
    if extended:
        cols |= {
            "prev_year_growth_rate": "lag(med) over w / nullif(lag(med, 2) over w, 0) - 1", f"prev_2yr_mean_{m}": "lag(mean_, 2) over w",
            f"prev_3yr_rolling_mean_{m}": f"case when {seen} >= 2 then avg(med) over r end", "prev_3yr_value_std": f"case when {seen} >= 2 then stddev_samp(med) over r end",
        }
    shown = ", ".join(f"{e} as {prefix}_{c}" for c, e in cols.items())
    return f"""select REPORT_YEAR, {group}, {shown} from (select *, row_number() over (partition by {group} order by REPORT_YEAR) as i from (
 select REPORT_YEAR, {group}, quantile_cont(CURRENT_LAND_VALUE, 0.5) as med, avg(CURRENT_LAND_VALUE) as mean_, count(CURRENT_LAND_VALUE) as n from features group by 1, 2))
 window w as (partition by {group} order by REPORT_YEAR), r as (partition by {group} order by REPORT_YEAR rows between 3 preceding and 1 preceding)"""


PLAIN_HISTORY = {
    "neigh": hist.history_names("neigh", "land_value", True),
    **{p: [c for c in hist.history_names(p, "land_value", False) if not c.endswith("growth_rate")] for p in ("fsa", "plan")},
}
MODEL_PARTS = [
    *st.FEATURE_PARTS,
    ("s0", SUPPLY_SQL),
    ("s1", "select REPORT_YEAR + 24 as REPORT_YEAR, net, converted from s0"),
    ("macro", _LAGS.replace(" from s ", " from s1 ")),
    ("h1", history_sql("features", "REPORT_YEAR", "NEIGHBOURHOOD_CODE", "CURRENT_LAND_VALUE", "neigh", True)),
    ("h2", history_sql("features", "REPORT_YEAR", "POSTAL_FSA", "CURRENT_LAND_VALUE", "fsa", False, False)),
    ("h3", history_sql("features", "REPORT_YEAR", "PLAN", "CURRENT_LAND_VALUE", "plan", False, False)),
    (
        "model",
        """select * from features left join macro using (REPORT_YEAR) left join h1 using (REPORT_YEAR, NEIGHBOURHOOD_CODE)
 left join h2 using (REPORT_YEAR, POSTAL_FSA) left join h3 using (REPORT_YEAR, PLAN)""",
    ),
]
MODEL = with_sql(*MODEL_PARTS)
_PLAIN = {
    "h1": plain_history_sql("NEIGHBOURHOOD_CODE", "neigh", True), "h2": plain_history_sql("POSTAL_FSA", "fsa", False), "h3": plain_history_sql("PLAN", "plan", False),
    "macro": "select REPORT_YEAR, net, lag(net) over w as net_lag1, net - lag(net) over w as net_yoy_change, converted, lag(converted) over w as converted_lag1, "
    "converted - lag(converted) over w as converted_yoy_change from s1 window w as (order by REPORT_YEAR)",
}
PLAIN_MODEL_PARTS = [(name, _PLAIN.get(name, sql)) for name, sql in MODEL_PARTS]


def model_table_parts(spark, sf):
    series = supply_series(spark, sf, 24)
    return mt.build_model_table(st.fact(spark, sf), {"supply": series, "absent": None})


@query(MODEL + "select * from model")
def model_table(spark, sf):
    out, _ = model_table_parts(spark, sf)
    return rounded_history(out)


@query(
    MODEL
    + """select metric, round(avg(v), 6) as value from (
 unpivot (select cast(neigh_prev_year_median_land_value is null as integer) as neigh_prev_year_median_land_value,
  cast(fsa_prev_year_median_land_value is null as integer) as fsa_prev_year_median_land_value,
  cast(plan_prev_3yr_growth_trend is null as integer) as plan_prev_3yr_growth_trend, cast(net_lag1 is null as integer) as net_lag1 from model)
 on columns(*) into name metric value v) group by 1"""
)
def model_table_null_rates(spark, sf):
    fact = st.fact(spark, sf)
    out, notes = model_table_parts(spark, sf)
    summary = mt.model_table_summary(fact, out, notes).where(F.col("section") == "missing_rate")
    wanted = ["neigh_prev_year_median_land_value", "fsa_prev_year_median_land_value", "plan_prev_3yr_growth_trend", "net_lag1"]
    return summary.where(F.col("metric").isin(wanted)).select("metric", F.round(F.col("value").cast("double"), 6).alias("value"))


def _report_sql() -> str:
    """Every row of the report: notes on what was made, the table's shape, and the share of NULLs of each new column."""
    made = ["REPORT_YEAR_NUM", "REPORT_YEAR_CENTERED", "PROPERTY_AGE", "BUILDING_AGE_BIN", "YEARS_SINCE_IMPROVEMENT", "HAS_BIG_IMPROVEMENT", "IMPROVEMENT_RECENCY_BIN", "POSTAL_FSA", "LEGAL_ZONING_COMBO"]
    macro = ["net", "net_lag1", "net_yoy_change", "converted", "converted_lag1", "converted_yoy_change"]
    groups = [c for names in PLAIN_HISTORY.values() for c in names]
    added = sorted([*[c for c in made if c not in ("PROPERTY_AGE", "YEARS_SINCE_IMPROVEMENT")], *macro, *groups])
    texts = lambda names: ", ".join(f"'{n}'" for n in names)
    rates = ", ".join(f"cast({c} is null as integer) as {c}" for c in added)
    return f"""select 'table' as section, 'fact_rows_before' as metric, cast(count(*) as varchar) as value from fact
union all select 'engineered_property_feature', unnest([{texts(made)}]), 'created' union all select 'engineered_macro_feature', unnest([{texts(macro)}]), 'merged'
union all select 'engineered_group_feature', unnest([{texts(groups)}]), 'created'
union all select 'source_status', unnest(['supply', 'absent', 'census_profile']), unnest(['merged', 'missing_input', 'deferred_default'])
union all select 'table', 'total_rows', cast(count(*) as varchar) from model union all select 'table', 'year_coverage', min(REPORT_YEAR) || '-' || max(REPORT_YEAR) from model
union all select 'table', 'sample_years_present', string_agg(y, ',' order by y) from (select distinct cast(REPORT_YEAR as varchar) as y from model)
union all select 'table', 'total_columns', cast(len(list_distinct(flatten(list(json_keys(j))))) as varchar) from (select to_json(m) as j from model m limit 1)
union all select 'table', 'new_columns_count', '{len(added)}' union all select 'table', 'new_columns', '{",".join(added)}'
union all select 'table', 'group_feature_families', 'neigh_history,fsa_history,plan_history'
union all select 'missing_rate', metric, printf('%.6f', avg(v)) from (unpivot (select {rates} from model) on columns(*) into name metric value v) group by 2"""


@query(MODEL + _report_sql())
def model_table_report(spark, sf):
    """The whole report; shares of NULLs with six digits."""
    report = _model_table_report(spark, sf)
    share = F.when(F.col("section") == "missing_rate", F.format_string("%.6f", F.col("value").try_cast("double"))).otherwise(F.col("value"))
    return report.withColumn("value", share)


def _model_table_report(spark, sf):
    out, notes = model_table_parts(spark, sf)
    return mt.model_table_summary(st.fact(spark, sf), stage(out), notes)


@query(
    MODEL
    + """select metric, round(avg(v), 6) as value from (unpivot (
 select cast(columns(* exclude (PID, REPORT_YEAR, NEIGHBOURHOOD_CODE, CURRENT_LAND_VALUE, LEGAL_TYPE, ZONING_DISTRICT, ZONING_CLASSIFICATION, PROPERTY_POSTAL_CODE, YEAR_BUILT,
  BIG_IMPROVEMENT_YEAR, LAND_COORDINATE, PLAN, LOT, PROPERTY_AGE, YEARS_SINCE_IMPROVEMENT)) is null as integer) from model) on columns(*) into name metric value v) group by 1"""
)
def model_table_null_rates_all(spark, sf):
    report = _model_table_report(spark, sf).where(F.col("section") == "missing_rate")
    return report.select("metric", F.round(F.col("value").cast("double"), 6).alias("value"))


@query(
    """with sides as (
 select 'twice' as what, count(*) as n, count(distinct c_nationkey) as keys, count(c_acctbal) as features from customer
 union all select 'good', count(*), count(distinct k), count(people) from (select c_nationkey as k, count(*) as people from customer group by 1)
 union all select 'no_features', count(*), count(distinct k), 0 from (select distinct c_nationkey as k from customer)
 union all select 'no_key', count(*), null, count(people) from (select c_nationkey as k, count(*) as people from customer group by 1)
 union all select 'absent', null, null, null union all select 'default', count(*), count(distinct c_nationkey), 1 from customer)
select what, case when what = 'default' then 'deferred_default' when n is null then 'deferred_missing_input' when keys is null then 'deferred_no_shared_geo_key'
 when features = 0 then 'deferred_no_census_features' when n > keys then 'deferred_non_unique_geo_key' else 'merged_on_NEIGHBOURHOOD_CODE' end as status from sides"""
)
def census_merge_decisions(spark, sf):
    fact = st.fact(spark, sf)
    customer = table(spark, sf, "customer").withColumn("NEIGHBOURHOOD_CODE", F.col("c_nationkey").cast("string"))
    good = customer.groupBy("NEIGHBOURHOOD_CODE").agg(F.count(F.lit(1)).alias("census_population_2021"))
    sides = {
        "default": (good, False),
        "absent": (None, True),
        "no_key": (good.withColumnRenamed("NEIGHBOURHOOD_CODE", "k"), True),
        "no_features": (good.select("NEIGHBOURHOOD_CODE"), True),
        "twice": (customer.select("NEIGHBOURHOOD_CODE", F.col("c_acctbal").alias("census_income")), True),
        "good": (good, True),
    }
    keys = ["NEIGHBOURHOOD_CODE", "POSTAL_FSA", "PROPERTY_POSTAL_CODE"]
    rows = [(what, mt.census_decision(fact, side, merge, keys)[0]) for what, (side, merge) in sides.items()]
    return spark.createDataFrame(rows, "what string, status string")


@query(
    FACT
    + """select f.PID, f.NEIGHBOURHOOD_CODE, c.census_population_2021 from fact f left join
 (select cast(c_nationkey as varchar) as k, count(*) as census_population_2021 from customer group by 1) c on f.NEIGHBOURHOOD_CODE = c.k"""
)
def census_merge(spark, sf):
    customer = table(spark, sf, "customer").withColumn("NEIGHBOURHOOD_CODE", F.col("c_nationkey").cast("string"))
    side = customer.groupBy("NEIGHBOURHOOD_CODE").agg(F.count(F.lit(1)).alias("census_population_2021"))
    fact = st.fact(spark, sf).select("PID", "NEIGHBOURHOOD_CODE")
    return mt.merge_census(fact, side, True, ["NEIGHBOURHOOD_CODE"])[0].select("PID", "NEIGHBOURHOOD_CODE", "census_population_2021")
