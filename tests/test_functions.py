"""Edge cases of the column functions."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from cadastra.functions import civic, errors, numbers, postal, text


def test_strip_covers_all_white_space(rows):
    assert rows(["  a b\t\n", " x", None, ""], text.strip_ws("x")) == ["a b", "x", None, ""]
    assert rows(["a b c\t"], text.drop_ws("x")) == ["abc"]


def test_unknown_marks(rows):
    values = ["", "nan", "NaN", "None", "none", "NaT", None, " RS-1 ", "Unknown"]
    assert rows(values, text.unknown_if_empty("x")) == [
        "Unknown", "Unknown", "NaN", "Unknown", "none", "Unknown", "Unknown", "RS-1", "Unknown",
    ]
    assert rows(values, text.category("x"))[:7] == ["Unknown"] * 7
    assert rows(["vap229", " unknown ", "", None, "a b"], text.plan_code("x")) == ["VAP229", "Unknown", "Unknown", "Unknown", "A B"]
    assert rows([" ", "nan", None], text.blank_to_unknown("x")) == ["Unknown", "nan", "Unknown"]


def test_numbers(rows):
    values = ["1d", "1f", "NaN", "inf", " 12 ", "1e3", ".5", "5.", "-2", "", None, "1,0", "abc", "1_000"]
    assert rows(values, numbers.to_number("x")) == [
        None, None, None, None, 12.0, 1000.0, 0.5, 5.0, -2.0, None, None, None, None, None,
    ]
    assert rows(["1,234", "..", "...", "--", "", " 7 "], numbers.footnoted_number("x")) == [1234.0, None, None, None, None, 7.0]
    assert rows(["12.0", "12.9", "x"], numbers.to_year(numbers.to_number("x"))) == [12, 12, None]


def test_numeric_columns_lose_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (1.5,)], "v double")
    assert [r[0] for r in df.select(numbers.number_of(df, "v")).collect()] == [None, 1.5]


def test_bins_are_right_closed(rows):
    years = [1949.0, 1950.0, 1979.0, 1980.0, 1999.0, 2000.0, None]
    assert rows(years, numbers.building_age_bin("x"), "double") == [
        "pre_1950", "1950_1979", "1950_1979", "1980_1999", "1980_1999", "2000_plus", "unknown",
    ]
    assert rows([5.0, 6.0, 15.0, 30.0, 31.0], numbers.improvement_recency_bin("x"), "double") == [
        "0_5y", "6_15y", "6_15y", "16_30y", "31y_plus",
    ]
    assert rows([-1.0, 0.0, 250.0, 251.0, None], numbers.null_outside("x", 0, 250), "double") == [None, 0.0, 250.0, None, None]


def test_month_labels(rows):
    values = ["January 1951", " March 2020 ", "Total", None, "2020"]
    assert rows(values, numbers.month_label_date("x")) == [datetime.date(1951, 1, 1), datetime.date(2020, 3, 1), None, None, None]


def test_postal_codes(rows):
    values = ["V6H 2J4", "v6h2j4", "v6h 2j4", "V6H-2J4", "K1", "unknown", None, "nan"]
    assert rows(values, postal.postal_code("x")) == ["V6H2J4", "V6H2J4", "V6H2J4", "V6H-2J4", "K1", "Unknown", "Unknown", "Unknown"]
    assert rows(values, postal.postal_code("x", drop_dashes=True))[3] == "V6H2J4"
    assert rows(values, postal.is_valid_postal("x")) == [True, True, True, False, False, False, False, False]
    assert rows(["V6H2J4", "K1", "Unknown"], postal.postal_fsa("x")) == ["V6H", "Unknown", "Unknown"]
    assert rows(["v6h-2j4", "K1", None], postal.lookup_postal("x")) == ["V6H2J4", "K1", ""]
    assert rows(["v6h-2j4", "K1", None], postal.lookup_fsa("x")) == ["V6H", "", ""]
    assert rows(["at v6h-2j4, please", "AV6H2J4", "no"], postal.postal_in_text("x")) == ["V6H2J4", None, None]


def test_civic_numbers(rows):
    values = [" 1050 ", "1050.0", "1050a", "1050.50", "nan", None, "10 50"]
    assert rows(values, civic.civic_number("x")) == ["1050", "1050", "1050A", "1050.50", "", "", "1050"]
    assert rows(values, civic.civic_int("x")) == [1050, 1050, 1050, 1050, None, None, 1050]
    assert rows(["99999999999999999999"], civic.civic_int("x")) == [None]
    assert rows(["26th-ave. w", "26TH  Ave W", None], text.street_name("x")) == ["26TH AVE W", "26TH AVE W", ""]


def test_display_address(spark):
    df = spark.createDataFrame(
        [("1040", "1060"), ("1040.0", "1040"), (None, "7"), ("", None)], "a string, b string"
    ).withColumn("i", F.monotonically_increasing_id())
    shown = df.select("i", civic.display_address("a", "b", F.lit(" MAIN ST "), F.lit("V6H 2J4")).alias("d")).orderBy("i")
    assert [r["d"] for r in shown.collect()] == [
        "1040-1060 MAIN ST, V6H 2J4", "1040 MAIN ST, V6H 2J4", "7 MAIN ST, V6H 2J4", "UNKNOWN MAIN ST, V6H 2J4",
    ]


def test_blocks_cover_a_range_exactly_once(spark):
    ranges = [(a, a + w) for a in (0, 1, 5, 1000, 123456) for w in (0, 1, 2, 7, 8, 20, 1000)]
    df = spark.createDataFrame(ranges, "lo long, hi long")
    for r in df.select("lo", "hi", civic.cover_blocks("lo", "hi").alias("b")).collect():
        held = [n for b in r["b"] for n in range(b["block"] << b["level"], (b["block"] + 1) << b["level"])]
        assert sorted(held) == list(range(r["lo"], r["hi"] + 1))


def test_errors(spark):
    df = spark.createDataFrame([(100.0, 90.0), (0.0, 5.0)], "t double, p double")
    out = df.select(errors.abs_error("t", "p"), errors.sq_error("t", "p"), errors.ape("t", "p"), errors.capped("t", 50)).collect()
    assert [tuple(r) for r in out] == [(10.0, 100.0, 0.1, 50.0), (5.0, 25.0, None, 0.0)]
    assert df.select(errors.unlog_prediction(F.lit(-3.0))).first()[0] == 0.0
