"""Source formats with their irregularities."""

from __future__ import annotations

import io
import zipfile

import pytest

from cadastra.sources import census, monthly, sheets
from cadastra.sources.delimited import read_columns, read_optional_json, read_optional_table, default_year
from cadastra.sources.sinks import write_metadata, write_report
from cadastra.sources.workbook import read_workbooks
from cadastra.operators.yearly import yearly_from_monthly

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PKG = "http://schemas.openxmlformats.org/package/2006/relationships"


def test_monthly_file(spark, tmp_path):
    body = (
        '"Table, with a title"\n"Notes"\n'
        '"Geography","December 1950","January 1951","February 1951","March 1951","June 1952","Source"\n'
        '"Alberta",1,1,1,1,1,"x"\n"Canada",5.00,5.75,"6.25",..,7,"bank"\n"Canada",9,9,9,9,9,"later"\n'
    )
    (tmp_path / "rates.csv").write_text(body, encoding="utf-8")
    long = monthly.read_monthly(spark, str(tmp_path / "rates.csv"))
    out = yearly_from_monthly(long, "date", "value", "avg", "last", "y").orderBy("y")
    assert [tuple(r) for r in out.collect()] == [(1950, 5.0, 5.0), (1951, 6.0, 6.25), (1952, 7.0, 7.0)]
    with pytest.raises(ValueError, match="no row for"):
        monthly.read_monthly(spark, str(tmp_path / "rates.csv"), "Mars")
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="no header line"):
        monthly.read_monthly(spark, str(tmp_path / "bad.csv"))


def book(path, sheet_xml: str, shared: list[str], name: str = "PR - CMA") -> None:
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="Other" sheetId="1" r:id="r1"/><sheet name="{name}" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PKG}"><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="/xl/worksheets/b.xml"/></Relationships>')
        z.writestr("xl/worksheets/a.xml", f'<worksheet xmlns="{MAIN}"><sheetData><row><c r="A1"><v>1</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/b.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{sheet_xml}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si>{t}</si>" for t in shared) + "</sst>")


def test_workbooks(spark, tmp_path):
    shared = ["<t>2015 Total</t>", "<r><t>2016 </t></r><r><t>Total</t></r>", "<t>Vancouver</t>", "<t>British Columbia Total</t>"]
    rows = (
        '<row r="1"><c r="C1" t="s"><v>0</v></c></row><row r="2"/>'
        '<row r="3"><c r="A3" t="inlineStr"><is><t>Area</t></is></c><c r="C3" t="s"><v>0</v></c><c r="E3" t="s"><v>1</v></c></row>'
        '<row r="4"><c r="B4" t="s"><v>2</v></c><c r="C4"><v>1</v></c><c r="E4"><v>2</v></c></row>'
        '<row r="5"><c r="B5" t="s"><v>2</v></c><c r="C5" t="inlineStr"><is><t>1,234</t></is></c></row>'
        '<row r="6"><c r="A6" t="s"><v>3</v></c><c r="C6" t="inlineStr"><is><t>--</t></is></c><c r="AA6"><v>9</v></c><c r="E6"><v>77</v></c></row>'
    )
    book(tmp_path / "one.xlsx", rows, shared)
    book(tmp_path / "two.xlsx", rows.replace("77", "88"), shared)
    cells = read_workbooks(spark, [str(tmp_path / "one.xlsx"), str(tmp_path / "two.xlsx")], "PR - CMA")
    one = cells.where("path like '%one.xlsx'")
    assert one.where("value = 'Vancouver'").count() == 2
    assert one.where("col_idx = 26").first()["row_idx"] == 4
    out, note = sheets.permanent_residents(one)
    assert [(r["REPORT_YEAR"], r["ircc_pr_vancouver_cma"], r["ircc_pr_bc_total"]) for r in out.orderBy("REPORT_YEAR").collect()] == [
        (2015, 1234.0, None), (2016, None, 77.0),
    ]
    assert "city" in note
    permits, _ = sheets.study_permits(cells)
    assert sorted((r["path"][-8:], r["REPORT_YEAR"], r["study_permits_bc_total"]) for r in permits.collect() if r["REPORT_YEAR"] == 2016) == [
        ("one.xlsx", 2016, 77.0), ("two.xlsx", 2016, 88.0),
    ]
    with pytest.raises(ValueError, match="sheet not found"):
        sheets.study_permits(read_workbooks(spark, str(tmp_path / "one.xlsx"), "None"))
    with pytest.raises(ValueError, match="Total"):
        sheets.study_permits(read_workbooks(spark, str(tmp_path / "one.xlsx"), "Other"))
    province, note = sheets.permanent_residents(one.where("value <> 'Vancouver'"))
    assert "ircc_pr_vancouver_cma" not in province.columns and "fallback" in note


def test_census(spark, tmp_path):
    head = "CENSUS_YEAR,DGUID,GEO_LEVEL,GEO_NAME,CHARACTERISTIC_ID,CHARACTERISTIC_NAME,C1_COUNT_TOTAL,C10_RATE_TOTAL\n"
    lines = [
        '2021,2021S0505,CMA,Vancouver,2,"Population, 2021","5,000",', '2021,2021S0505,CMA,Vancouver,1,"Population, 2021",..,',
        "2021,2021S0505,CMA,Vancouver,3,  65 years and over,900,300", "2021,2021S0505,CMA,Vancouver,4,65 years and over,,17.5",
        "2021,2021S0599,CMA,Québec,2,Owner,1,", "2021,2021A0002,CSD,Vancouver,9,Owner,40,",
        "2021,2021A0002,CSD,Vancouver,7,Median total income of household in 2020 ($),90000,",
    ]
    (tmp_path / "c.csv").write_text(head + "\n".join(lines), encoding="latin-1")
    geo = spark.createDataFrame(
        [(" Vancouver ", "2021S0505"), ("Vancouver", "2021S0506"), ("vancouver", "2021A0002"), ("Québec", "2021S0599")], ["Geo Name", "Geo Code"]
    )
    out = census.census_profile(census.read_profile(spark, str(tmp_path / "c.csv")), geo)
    got = {r["geo_scope"]: r for r in out.collect()}
    assert got["vancouver_cma"]["census_population_2021"] == 5000.0
    assert got["vancouver_cma"]["census_age_65_plus_pct"] == 17.5
    assert got["vancouver_csd"]["census_owner_households"] == 40.0
    assert got["vancouver_csd"]["census_median_household_income_2020"] == 90000.0
    assert got["vancouver_csd"]["census_population_2021"] is None
    assert got["vancouver_csd"]["CENSUS_YEAR"] == 2021
    with pytest.raises(ValueError, match="target geographies"):
        census.census_profile(census.read_profile(spark, str(tmp_path / "c.csv")), geo.where("1 = 0"))


def test_reports_and_optional_inputs(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5)], "k string, mean_abs_error double")
    write_report(df, str(tmp_path / "r"), note="made here")
    assert read_optional_table(spark, str(tmp_path / "r"), "k string, mean_abs_error double, note string").first()["note"] == "made here"
    assert read_optional_table(spark, str(tmp_path / "none"), "k string").count() == 0
    assert read_optional_table(spark, None, "k string").count() == 0
    lookup = spark.createDataFrame([(2024,), (2026,)], "REPORT_YEAR int")
    schema = "default_report_year int"
    assert lookup.select(default_year(read_optional_json(spark, None, schema), lookup, "REPORT_YEAR")).first()[0] == 2026
    write_metadata(spark.createDataFrame([(2025,)], schema), str(tmp_path / "m"))
    meta = read_optional_json(spark, str(tmp_path / "m"), schema)
    assert lookup.select(default_year(meta, lookup, "REPORT_YEAR")).first()[0] == 2025
    (tmp_path / "s.csv").write_text("Year,net\n2020,1\n")
    with pytest.raises(ValueError, match="new_added"):
        read_columns(spark, str(tmp_path / "s.csv"), ["Year", "new_added"])
