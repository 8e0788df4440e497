"""All steps from raw files to scored requests, once."""

from __future__ import annotations

import random

from test_sources import book

from cadastra.plans import jobs


def test_from_raw_files_to_scores(spark, tmp_path):
    path = lambda *p: str(tmp_path.joinpath(*p))
    rng = random.Random(2)
    head = "PID;REPORT_YEAR;NEIGHBOURHOOD_CODE;CURRENT_LAND_VALUE;LEGAL_TYPE;ZONING_DISTRICT;ZONING_CLASSIFICATION;PROPERTY_POSTAL_CODE;YEAR_BUILT;BIG_IMPROVEMENT_YEAR;LAND_COORDINATE;PLAN;LOT;EXTRA"
    lines = [head]
    for i in range(60):
        for y in range(2019, 2027):
            value = "" if i == 7 else str(100000 * (1 + i % 4) + 1000 * (y - 2019) + rng.randrange(500))
            lines.append(f"{i};{y};{i % 4};{value};{'STRATA' if i % 2 else 'LAND'};RS;RS-{i % 3};v{i % 4}h {i % 5}j4;{1900 + i};{'' if i % 3 else 2010};{i};vap{i % 6};{i % 9};x")
    (tmp_path / "raw.csv").write_text("\n".join(lines))
    (tmp_path / "rates.csv").write_text('"T"\n"Geography","January 1951","March 2020","May 2021"\n"Canada",1,2,3\n')
    (tmp_path / "supply.csv").write_text("Year,net_change_total,new_added,existing_converted\n2019,1,2,-3\n2020,4,5,6\n,1,1,1\n")
    sheet = (
        '<row><c r="C1" t="inlineStr"><is><t>2019 Total</t></is></c><c r="D1" t="inlineStr"><is><t>2020 Total</t></is></c></row>'
        '<row><c r="A2" t="inlineStr"><is><t>British Columbia Total</t></is></c><c r="C2"><v>5</v></c><c r="D2"><v>6</v></c></row>'
    )
    book(tmp_path / "pr.xlsx", sheet, [], jobs.RESIDENT_SHEET)
    book(tmp_path / "sp.xlsx", sheet, [], jobs.PERMIT_SHEET)
    (tmp_path / "census.csv").write_text(
        "CENSUS_YEAR,DGUID,GEO_LEVEL,GEO_NAME,CHARACTERISTIC_ID,CHARACTERISTIC_NAME,C1_COUNT_TOTAL,C10_RATE_TOTAL\n2021,2021A1,CSD,Vancouver,1,Owner,4,\n"
    )
    (tmp_path / "geo.csv").write_text("Geo Name,Geo Code\nVancouver,2021A1\n")

    jobs.clean(spark, path("raw.csv"), path("fact"), path("fact_report"))
    assert spark.read.parquet(path("fact")).count() == 59 * 7
    jobs.mortgage_rates(spark, path("rates.csv"), path("rates"), path("rates_report"))
    jobs.rental_supply(spark, path("supply.csv"), path("supply"), path("supply_report"))
    jobs.permanent_residents(spark, path("pr.xlsx"), path("pr"), path("pr_report"))
    jobs.study_permits(spark, path("sp.xlsx"), path("sp"), path("sp_report"))
    assert spark.read.option("header", True).csv(path("pr_report")).first()["note"].endswith("fallback.")
    jobs.census(spark, path("census.csv"), path("geo.csv"), path("census"), path("census_report"))
    series = {"mortgage_rate": path("rates"), "ircc_pr": path("pr"), "ircc_study_permits": path("sp"), "cmhc_rental": path("supply"), "absent": path("absent")}
    jobs.model_table(spark, path("fact"), path("model_table"), path("model_report"), census=path("census"), merge_census="yes", **series)
    report = {(r["section"], r["metric"]): r["value"] for r in spark.read.option("header", True).csv(path("model_report")).collect()}
    assert report[("source_status", "absent")] == "missing_input" and report[("source_status", "mortgage_rate")] == "merged"
    assert report[("source_status", "census_profile")] == "deferred_no_shared_geo_key"
    assert report[("table", "total_rows")] == str(59 * 7)

    jobs.train_model(spark, path("model_table"), path("model"), path("reports"), trees="2")
    asked = spark.createDataFrame(
        [(1, "V1H 0J4", "LAND", "RS", "RS-1", "1", "1950", None, None)],
        "request_id int, PROPERTY_POSTAL_CODE string, LEGAL_TYPE string, ZONING_DISTRICT string, ZONING_CLASSIFICATION string, "
        "NEIGHBOURHOOD_CODE string, YEAR_BUILT string, BIG_IMPROVEMENT_YEAR string, REPORT_YEAR string",
    )
    asked.write.parquet(path("requests"))
    jobs.score(spark, path("requests"), path("model"), path("model_table"), path("reports"), path("scores"), path("refused"))
    row = spark.read.parquet(path("scores")).first()
    assert row["error_band_source"] == "neighbourhood_mean_abs_error" and 100000 < row["point_estimate"] < 350000
    assert spark.read.parquet(path("refused")).count() == 0
    table = spark.read.parquet(path("model_table"))
    table.where("REPORT_YEAR < 2026").write.parquet(path("older"))
    table.where("REPORT_YEAR = 2026").write.parquet(path("newest"))
    jobs.completion_levels(spark, path("older"), path("levels_before"))
    jobs.completion_levels(spark, path("newest"), path("levels"), added_to=path("levels_before"))
    jobs.score(spark, path("requests"), path("model"), path("model_table"), path("reports"), path("scores3"), path("refused3"), completion=path("levels"))
    assert spark.read.parquet(path("scores3")).first() == row
    jobs.score(spark, path("requests"), path("model"), path("model_table"), path("nothing"), path("scores2"), path("refused2"))
    assert spark.read.parquet(path("scores2")).first()["error_band_source"] == "fallback_20pct"


def test_address_and_option_steps(spark, tmp_path):
    path = lambda *p: str(tmp_path.joinpath(*p))
    head = "PID;REPORT_YEAR;PROPERTY_POSTAL_CODE;STREET_NAME;LEGAL_TYPE;ZONING_DISTRICT;ZONING_CLASSIFICATION;NEIGHBOURHOOD_CODE;YEAR_BUILT;FROM_CIVIC_NUMBER;TO_CIVIC_NUMBER"
    lines = [head] + [f"{i};2026;V{i % 3}H 0J4;{'OAK ST' if i % 2 else 'ELM AVE'};LAND;RS;RS-1;{i % 4};1950;;{100 + i}" for i in range(40)]
    (tmp_path / "extract.csv").write_text("\n".join(lines))
    jobs.address_table(spark, path("extract.csv"), path("addresses"))
    table = spark.read.parquet(path("addresses"))
    assert table.count() == 40 and "PID" not in table.columns
    requests = spark.createDataFrame(
        [(1, "107", "oak", "v1h0j4", 2026, 5), (2, "107", "birch", None, None, 5), (3, "999", "oak", None, None, 5), (4, "107", "o", None, 2026, 20), (5, "107", "oak", None, 2026, 21)],
        "request_id int, street_number string, street_name string, property_postal_code string, report_year int, `limit` int",
    )
    requests.write.parquet(path("asked"))
    jobs.address_index(spark, path("addresses"), path("index"))
    jobs.address_lookup(spark, path("asked"), path("index"), "2026", path("found"), path("outcome"), path("refused"))
    assert [(r["request_id"], r["errors"]) for r in spark.read.parquet(path("refused")).collect()] == [(5, ["limit_out_of_range"])]
    outcome = {r["request_id"]: (r["match_count"], r["auto_selected"], r["postal_match_mode"]) for r in spark.read.parquet(path("outcome")).collect()}
    assert outcome == {1: (1, True, "exact"), 2: (1, True, "none"), 3: (0, False, "none"), 4: (1, True, "none"), 5: (0, False, "none")}
    modes = {r["request_id"]: r["name_match_mode"] for r in spark.read.parquet(path("found")).collect()}
    assert modes == {1: "contains", 2: "none", 4: "contains"}

    partly = spark.createDataFrame(
        [(1, "land", None, None, None, None, 2026), (2, "strata", None, None, "1", None, 2026)],
        "request_id int, legal_type string, zoning_district string, zoning_classification string, neighbourhood_code string, property_postal_code string, report_year int",
    )
    partly.write.parquet(path("partly"))
    jobs.options(spark, path("partly"), path("addresses"), "2026", path("options"), path("contexts"))
    ranked = {(r["request_id"], r["facet"], r["rank"]): (r["option"], r["rows"]) for r in spark.read.parquet(path("options")).collect()}
    assert ranked[(1, "LEGAL_TYPE", 1)] == ("LAND", 40) and ranked[(2, "NEIGHBOURHOOD_CODE", 1)] == ("1", 10)
