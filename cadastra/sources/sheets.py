"""Yearly series out of a long cell table with ``2015 Total`` column heads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cadastra.functions.numbers import footnoted_number
from cadastra.functions.text import fold, strip_ws
from cadastra.operators.checks import require_rows

# Fixed value: the head of a year column.
YEAR_TOTAL = r"^(20\d{2})\s*Total$"
BOOK = ["path", "sheet"]


def year_total_columns(cells: DataFrame, pattern: str = YEAR_TOTAL, header_rows: int | None = None) -> DataFrame:
    """``path, sheet, year, col_idx`` of the row with most year heads.

    The first such row wins, and in it the last column of a year. All rows are
    searched, or the first ``header_rows``.
    """
    year = F.regexp_extract(strip_ws("value"), pattern, 1)
    heads = cells.where((year != "") & (F.lit(True) if header_rows is None else F.col("row_idx") < header_rows)).withColumn("year", year.cast("int"))
    rows = heads.groupBy(*BOOK, "row_idx", "year").agg(F.max("col_idx").alias("col_idx"))
    sizes = rows.groupBy(*BOOK, "row_idx").agg(F.count(F.lit(1)).alias("years"))
    best = sizes.groupBy(*BOOK).agg(F.min_by("row_idx", F.struct(-F.col("years"), "row_idx")).alias("row_idx"))
    return rows.join(best, [*BOOK, "row_idx"]).select(*BOOK, "year", "col_idx")


def labelled_rows(cells: DataFrame, col_idx: int, label: str, last: bool) -> DataFrame:
    """``path, sheet, row_idx`` of the first or last row with a label in a column."""
    hits = cells.where((F.col("col_idx") == col_idx) & (fold("value") == label))
    pick = F.max("row_idx") if last else F.min("row_idx")
    return hits.groupBy(*BOOK).agg(pick.alias("row_idx"))


def yearly_from_sheet(cells: DataFrame, rules: dict[str, tuple[int, str, bool]], year: str) -> DataFrame:
    """One row per workbook and year with a column per rule ``{name: (col, label, last)}``.

    A labelled row that is too short for a year gives NULL.
    """
    columns = year_total_columns(cells)
    parts = []
    for name, (col_idx, label, last) in rules.items():
        rows = labelled_rows(cells, col_idx, label, last)
        parts.append(rows.select(*BOOK, "row_idx", F.lit(name).alias("series")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    wanted = rows.join(columns, BOOK)
    values = wanted.join(cells.select(*BOOK, "row_idx", "col_idx", "value"), [*BOOK, "row_idx", "col_idx"], "left")
    return (
        values.withColumn("number", footnoted_number("value"))
        .groupBy(*BOOK, F.col("year").alias(year))
        .pivot("series", list(rules))
        .agg(F.first("number"))
    )


def checked_yearly_from_sheet(
    cells: DataFrame, rules: dict[str, tuple[int, str, bool]], year: str
) -> DataFrame:
    """``yearly_from_sheet`` that refuses a sheet without year heads or labelled rows."""
    require_rows(cells, "sheet not found")
    require_rows(year_total_columns(cells), "no 'YYYY Total' columns found")
    return require_rows(yearly_from_sheet(cells, rules, year), "no labelled row found")


# The rows of the permanent-resident and the study-permit sheet.
PERMANENT_RESIDENT_ROWS = {
    "ircc_pr_vancouver_cma": (1, "vancouver", True),
    "ircc_pr_bc_total": (0, "british columbia total", True),
}
STUDY_PERMIT_ROWS = {"study_permits_bc_total": (0, "british columbia total", False)}


def permanent_residents(cells: DataFrame, year: str = "REPORT_YEAR") -> tuple[DataFrame, str]:
    """City series if its row exists, province series as well or instead, and a note."""
    city = not labelled_rows(cells, 1, "vancouver", True).isEmpty()
    rules = {n: r for n, r in PERMANENT_RESIDENT_ROWS.items() if city or n != "ircc_pr_vancouver_cma"}
    if city and labelled_rows(cells, 0, "british columbia total", True).isEmpty():
        rules.pop("ircc_pr_bc_total")
    note = "Using the city series." if city else "City row not found; using the province total as fallback."
    return checked_yearly_from_sheet(cells, rules, year), note


def study_permits(cells: DataFrame, year: str = "REPORT_YEAR") -> tuple[DataFrame, str]:
    return checked_yearly_from_sheet(cells, STUDY_PERMIT_ROWS, year), "Using the province total by year."
