"""Stored state, sketches, guards, pruned reads and the writers, on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.operators import checks, counts, history_store, pruning, sketches
from cadastra.plans import importance
from cadastra.session import stage
from cadastra.sources import delimited, sheets, sinks
from registry import standins as st
from registry.cleaning import FACT, FEATURES, scratch
from registry.core import query, table, with_sql
from registry.lookups import scoring_requests, scoring_sql, _N
from registry.series import history_sql, rounded_history


@query(FACT + history_sql("fact", "REPORT_YEAR", "NEIGHBOURHOOD_CODE", "CURRENT_LAND_VALUE", "neigh", True))
def history_with_new_years(spark, sf):
    """A stored history to which two years and late facts of an old one are added: as a rebuild from all facts."""
    facts = stage(st.fact(spark, sf).select("PID", "REPORT_YEAR", "NEIGHBOURHOOD_CODE", "CURRENT_LAND_VALUE"))
    late = (F.col("REPORT_YEAR") == 2022) & (F.pmod(F.xxhash64("PID"), F.lit(7)) == 0)
    path = scratch(spark, "history")
    for batch in ((F.col("REPORT_YEAR") < 2024) & ~late, F.col("REPORT_YEAR") == 2024, (F.col("REPORT_YEAR") > 2024) | late):
        history_store.add_facts(spark, facts.where(batch), path, "REPORT_YEAR", "NEIGHBOURHOOD_CODE", "CURRENT_LAND_VALUE")
    return rounded_history(history_store.stored_history(spark, path, "REPORT_YEAR", "NEIGHBOURHOOD_CODE", "neigh", True))


_SKETCHED = "select l_returnflag, cast(year(l_shipdate) as integer) as y, l_extendedprice as v from lineitem"


@query(
    f"""with r as ({_SKETCHED})
select 'year' as level, l_returnflag, y, count(*) as n, true as p50_within, true as p90_within from r group by 2, 3
union all select 'flag', l_returnflag, null, count(*), true, true from r group by 2 union all select 'all', null, null, count(*), true, true from r"""
)
def sketch_rank_errors(spark, sf):
    """Sketches per flag and year, merged per flag and for all rows; every quantile's exact rank is within the bound."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", F.year("l_shipdate").alias("y"), F.col("l_extendedprice").alias("v"))
    probs = {"p50": 0.5, "p90": 0.9}
    finest = stage(sketches.group_sketches(rows, ["l_returnflag", "y"], "v"))
    levels = {"year": (finest, ["l_returnflag", "y"]), "flag": (sketches.merged_sketches(finest, ["l_returnflag"]), ["l_returnflag"]), "all": (sketches.merged_sketches(finest, []), [])}
    parts = []
    for level, (made, keys) in levels.items():
        found = stage(sketches.sketch_quantiles(made, keys, probs))
        errors = sketches.with_rank_errors(found, rows, keys, "v", probs)
        shown = [F.col(k) if k in keys else F.lit(None).cast(kind).alias(k) for k, kind in (("l_returnflag", "string"), ("y", "int"))]
        within = [(F.col(f"{p}_error") <= 2 * sketches.rank_error()).alias(f"{p}_within") for p in probs]
        parts.append(errors.select(F.lit(level).alias("level"), *shown, "n", *within))
    return counts.union_all(parts)


@query("select l_orderkey, count(*) as n, quantile_disc(l_extendedprice, 0.5) as p50, max(l_extendedprice) as p100 from lineitem group by 1")
def sketch_quantiles_of_small_groups(spark, sf):
    """A sketch of fewer values than its size holds all of them, so its quantiles are exact."""
    line = table(spark, sf, "lineitem")
    made = sketches.group_sketches(line, ["l_orderkey"], "l_extendedprice")
    return sketches.sketch_quantiles(made, ["l_orderkey"], {"p50": 0.5, "p100": 1.0})


@query(
    """select 'unique' as side, (select count(*) from orders) as before, (select count(*) from orders left join customer on o_custkey = c_custkey) as after, false as refused
union all select 'repeated', (select count(*) from orders), (select count(*) from orders left join (select l_orderkey from lineitem) on o_orderkey = l_orderkey), true"""
)
def joined_row_counts(spark, sf):
    """Rows before and after a join, both counted while its result is written; a join that adds rows is refused."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    sides = {
        "unique": (table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey"),
        "repeated": (table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), "o_orderkey"),
    }
    parts = []
    for name, (side, key) in sides.items():
        guard = checks.RowGuard()
        stage(guard.after(guard.before(orders).join(side, key, "left")))
        before, after = guard.counts()
        try:
            guard.check()
            refused = False
        except ValueError:
            refused = True
        parts.append((name, before, after, refused))
    return spark.createDataFrame(parts, "side string, before long, after long, refused boolean")


@query(FACT + "select count(*) filter (REPORT_YEAR < 2024) as train_rows, count(*) filter (REPORT_YEAR >= 2024) as test_rows, cast(max(REPORT_YEAR) as integer) as last_year from fact")
def split_counts_while_writing(spark, sf):
    """Both sides of the time split, counted by the pass that writes the table."""
    _, _, seen = checks.staged_split(st.fact(spark, sf), "REPORT_YEAR", 2024)
    return spark.createDataFrame([(seen["train_rows"], seen["test_rows"], seen["last_year"])], "train_rows long, test_rows long, last_year int")


_ASKED = f"case when request_id % 11 = 3 then cast({_N['REPORT_YEAR']} as integer) end"


@query(with_sql(*st.FACT_PARTS, ("request", scoring_sql())) + f"select REPORT_YEAR, PID, CURRENT_LAND_VALUE from fact where REPORT_YEAR in (select {_ASKED} from request where {_N['REPORT_YEAR']} % 2 = 0)")
def rows_of_asked_years(spark, sf):
    """Facts of the years that some requests ask for, from a table partitioned by year."""
    path = scratch(spark, "by_year")
    sinks.write_table(st.fact(spark, sf), path, ["REPORT_YEAR"])
    asked = scoring_requests(spark, sf).where((F.col("request_id") % 11 == 3) & (F.col("REPORT_YEAR").cast("int") % 2 == 0))
    found = pruning.rows_of_asked_years(spark.read.parquet(path), "REPORT_YEAR", asked, F.col("REPORT_YEAR"))
    return found.select("REPORT_YEAR", "PID", "CURRENT_LAND_VALUE")


@query(
    FACT
    + """, w as (select 'there' as path, NEIGHBOURHOOD_CODE, count(*) as count, round(avg(CURRENT_LAND_VALUE), 2) as mean_abs_error from fact group by 2)
select path, NEIGHBOURHOOD_CODE, count, mean_abs_error from w"""
)
def optional_reports(spark, sf):
    """A report that was written earlier, and one that wasn't: the latter has no rows and the same columns."""
    schema = "NEIGHBOURHOOD_CODE string, count long, mean_abs_error double"
    path = scratch(spark, "errors")
    made = st.fact(spark, sf).groupBy("NEIGHBOURHOOD_CODE").agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("CURRENT_LAND_VALUE"), 2).alias("mean_abs_error"))
    sinks.write_report(made, path)
    there = delimited.read_optional_table(spark, path, schema).withColumn("path", F.lit("there"))
    absent = delimited.read_optional_table(spark, f"{path}-absent", schema).withColumn("path", F.lit("absent"))
    return there.unionByName(absent)


@query(
    FACT
    + """select 'written' as metadata, cast(max(REPORT_YEAR) - 1 as integer) as default_year from fact union all select 'absent', cast(max(REPORT_YEAR) as integer) from fact"""
)
def default_year_of_metadata(spark, sf):
    """The default year that a metadata file names, else the last year of the facts."""
    schema = "default_report_year int, target string"
    facts = st.fact(spark, sf)
    path = scratch(spark, "metadata")
    sinks.write_metadata(facts.agg((F.max("REPORT_YEAR") - 1).alias("default_report_year"), F.lit("CURRENT_LAND_VALUE").alias("target")), path)
    years = facts.select("REPORT_YEAR")
    rows = []
    for name, place in (("written", path), ("absent", f"{path}-absent")):
        meta = delimited.read_optional_json(spark, place, schema)
        rows.append(spark.range(1).select(F.lit(name).alias("metadata"), delimited.default_year(meta, years, "REPORT_YEAR").alias("default_year")))
    return counts.union_all(rows)


@query("select p_brand, cast(count(*) as varchar) as parts, 'counted by brand' as note from part group by 1")
def report_with_note(spark, sf):
    """A report as it is written: texts under a header, with a note in every row."""
    path = scratch(spark, "report")
    sinks.write_report(table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("parts")), path, "counted by brand")
    return delimited.read_text_table(spark, path)


@query("select max(p_size) as largest, list_sort(list(distinct p_brand)) as brands from part")
def metadata_as_json(spark, sf):
    """One row of facts with a list, written as JSON and read back under its schema."""
    path = scratch(spark, "json")
    sinks.write_metadata(table(spark, sf, "part").agg(F.max("p_size").alias("largest"), F.array_sort(F.collect_set("p_brand")).alias("brands")), path)
    return delimited.read_optional_json(spark, path, "largest int, brands array<string>")


@query(
    """with b as (select p_brand as feature, round(sum(p_retailprice), 4) as importance_abs from part group by 1)
select feature, importance_abs, cast(row_number() over (order by importance_abs desc, feature) as integer) as importance_rank from b qualify importance_rank <= 20"""
)
def chart_top_importances(spark, sf):
    """The rows of the importance chart."""
    brands = table(spark, sf, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.round(F.sum("p_retailprice"), 4).alias("importance"))
    top = importance.top_importances(importance.importance_table(brands))
    return top.select("feature", "importance_abs", "importance_rank")


@query(
    """select 'nation-' || n_nationkey as path, min(o_orderkey) as first_row, max(o_orderkey) as last_row
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderstatus = 'F' group by 1"""
)
def first_and_last_labelled_rows(spark, sf):
    """Of the rows of a sheet with one label, the first one and the last one; a row for each order, its status the label."""
    rows = st.joined(spark, sf)
    cells = rows.select(
        F.concat(F.lit("nation-"), F.col("c_nationkey")).alias("path"), F.lit("orders").alias("sheet"), F.col("o_orderkey").alias("row_idx"),
        F.explode(F.array(F.struct(F.lit(0).alias("col_idx"), F.concat(F.lit("  "), F.col("o_orderstatus")).alias("value")), F.struct(F.lit(1).alias("col_idx"), F.lit("f").alias("value")))).alias("c"),
    ).select("path", "sheet", "row_idx", "c.*")
    first, last = (sheets.labelled_rows(cells, 0, "f", at_end).withColumnRenamed("row_idx", name) for at_end, name in ((False, "first_row"), (True, "last_row")))
    return first.join(last, sheets.BOOK).select("path", "first_row", "last_row")


@query(
    FEATURES
    + """select c as column_name from (select unnest(['YEAR_BUILT', 'BIG_IMPROVEMENT_YEAR', 'LAND_COORDINATE']) as c, unnest([count(YEAR_BUILT), count(BIG_IMPROVEMENT_YEAR), count(LAND_COORDINATE)]) as n from features)
where n > 0"""
)
def usable_numeric_columns(spark, sf):
    """Columns with a value; one that is NULL throughout is none."""
    rows = st.features(spark, sf).select("YEAR_BUILT", "BIG_IMPROVEMENT_YEAR", "LAND_COORDINATE", F.lit(None).cast("double").alias("empty"))
    usable = checks.usable_numeric_columns(rows, rows.columns)
    return spark.createDataFrame([(c,) for c in usable], "column_name string")
