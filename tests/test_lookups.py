"""Lookups against brute force on small tables with hot keys and wide ranges."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cadastra.operators import addresses, completion, facets, ranges, requests
from cadastra.session import stage

CANDIDATES = addresses.CANDIDATE_COLUMNS


def address_rows(n: int = 400):
    rng = random.Random(3)
    streets = ["MAIN ST", "W MAIN ST", "26TH-AVE. W", "26th ave w", "OAK", "A", ""]
    rows = []
    for i in range(n):
        low = 100 if i % 3 == 0 else rng.randrange(1, 300)
        high = {0: None, 1: str(low), 2: str(low + rng.randrange(0, 40)), 3: str(low - rng.randrange(0, 40)), 4: str(low + 5000)}[i % 5]
        first = None if i % 17 == 0 else rng.choice([f"{low}", f"{low}.0", f"{low}A"])
        rows.append(
            (i, rng.choice(["2024", "2025", "2026", "x"]), rng.choice(["V6H 2J4", "v6h2j9", "V5K-1A1", None]), first, high, rng.choice(streets),
             "STRATA", "RS", "RS-1", rng.choice(["1", "2"]), "1990", None)
        )
    return rows


def brute_addresses(table, asked, default_year):
    """The cascade for one request at a time."""
    out = {}
    years = {r["REPORT_YEAR"] for r in table}
    for q in asked:
        year = q["report_year"] or default_year
        left = [r for r in table if year not in years or r["REPORT_YEAR"] == year]
        digits = "".join(c for c in q["street_number"].strip().split(" ")[0] if c.isdigit())
        left = [r for r in left if digits and r["CIVIC_LOW"] is not None and r["CIVIC_LOW"] <= int(digits) <= r["CIVIC_HIGH"]]
        street = q["street_name"].upper().strip()
        for keep in (lambda r: r["STREET_NAME_NORMALIZED"] == street, lambda r: street in r["STREET_NAME_NORMALIZED"]):
            if any(keep(r) for r in left):
                left = [r for r in left if keep(r)]
                break
        postal = (q["property_postal_code"] or "").upper().replace(" ", "").replace("-", "")
        if postal:
            for keep in (lambda r: r["POSTAL_CODE_NORMALIZED"] == postal, lambda r: len(postal) >= 3 and r["POSTAL_FSA"] == postal[:3]):
                if any(keep(r) for r in left):
                    left = [r for r in left if keep(r)]
                    break
        seen, picked = set(), []
        for r in sorted(left, key=lambda r: r["ROW_ID"]):
            key = tuple(r[c] for c in CANDIDATES)
            if key not in seen:
                seen.add(key)
                picked.append(r["DISPLAY_ADDRESS"])
        out[q["request_id"]] = picked[: q["limit"]]
    return out


@pytest.fixture(scope="module")
def address_source(spark):
    names = ["row_id", *["REPORT_YEAR", "PROPERTY_POSTAL_CODE", "FROM_CIVIC_NUMBER", "TO_CIVIC_NUMBER", "STREET_NAME", "LEGAL_TYPE"],
             "ZONING_DISTRICT", "ZONING_CLASSIFICATION", "NEIGHBOURHOOD_CODE", "YEAR_BUILT", "BIG_IMPROVEMENT_YEAR"]
    return spark.createDataFrame(address_rows(), ", ".join(f"{n} {'int' if n == 'row_id' else 'string'}" for n in names))


def test_address_resolution_is_the_cascade(spark, address_source):
    table = addresses.address_table(address_source, "row_id")
    rng = random.Random(4)
    asked = [
        (i, rng.choice(["100", " 100A", "120", "7", "x", "299"]), rng.choice(["MAIN ST", "main", "26th ave w", "zzz", "", "A", "ST"]),
         rng.choice(["v6h 2j4", "V6H-9Z9", "K1A0B1", None, "V"]), rng.choice([2024, 2026, 1999, None]), rng.choice([1, 5, 20]))
        for i in range(150)
    ]
    df = spark.createDataFrame(asked, "request_id int, street_number string, street_name string, property_postal_code string, report_year int, limit int")
    found = addresses.resolve_addresses(df, table, F.lit(2025))
    got = {}
    for r in found.orderBy("request_id", "candidate_id").collect():
        got.setdefault(r["request_id"], []).append(r["DISPLAY_ADDRESS"])
    want = brute_addresses(table.collect(), df.collect(), 2025)
    assert got == {k: v for k, v in want.items() if v}
    outcome = {r["request_id"]: r for r in addresses.lookup_outcome(df, found).collect()}
    assert all(outcome[k]["match_count"] == len(v) and outcome[k]["auto_selected"] == (len(v) == 1) for k, v in want.items())


def test_no_request_is_sent_through_the_driver(spark, address_source):
    """Requests of few different values are small in a file and large in the driver, so no join sends them there."""
    seen = spark.createDataFrame([(i, "100", "MAIN", "V6H2J4", "2024", 3) for i in range(30)], "request_id int, street_number string, street_name string, property_postal_code string, report_year string, limit int")
    index = addresses.address_index(addresses.address_table(address_source, "row_id"))
    found = addresses.resolve_addresses(seen, index, F.lit(2025))
    nodes = spark.createDataFrame([(2024, 0, 100)], "_year int, level int, block long")
    texts = spark.createDataFrame([("MAIN ST",)], "text string")
    pairs = addresses.containing_texts(spark.createDataFrame([("MAIN",)], "pattern string"), "pattern", texts, "text")
    for df in (found, addresses.lookup_outcome(seen, found), addresses.asked_streets(index, nodes), pairs):
        assert df.count() > 0
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_stored_index_is_read_by_its_buckets(spark, address_source, tmp_path):
    path = f"file:{tmp_path}/index"
    addresses.write_address_index(addresses.address_table(address_source, "row_id"), path, max_limit=5)
    index = addresses.open_address_index(spark, path)
    streets, places = (stage(t.drop("ids").sample(0.5, 1)) for t in (index.streets, index.places))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for side, keys in ((streets.select(*addresses.NODE).distinct(), addresses.NODE), (places, addresses.PLACE)):
            joined = (index.streets if keys == addresses.NODE else index.places).join(side, keys)
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1  # the asked side
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert index.places.agg(F.max(F.size("ids"))).first()[0] == 5


def test_address_source_checks(address_source):
    with pytest.raises(ValueError, match="STREET_NAME"):
        addresses.address_table(address_source.drop("STREET_NAME"))
    with pytest.raises(ValueError, match="at least one of"):
        addresses.address_table(address_source.drop("FROM_CIVIC_NUMBER", "TO_CIVIC_NUMBER"))
    only_to = addresses.address_table(address_source.drop("FROM_CIVIC_NUMBER"), "row_id")
    assert only_to.where("CIVIC_LOW <> CIVIC_HIGH").count() == 0 and only_to.count() > 0


def test_containing_texts(spark):
    texts = ["MAIN ST", "EAST MAIN", "AB", "B", "ABAB"]
    patterns = ["A", "AB", "MAIN", "N S", "Q", "MAIN STREET", "B", ""]
    p = spark.createDataFrame([(x,) for x in patterns], "p string")
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    got = {tuple(r) for r in addresses.containing_texts(p, "p", t, "t").collect()}
    assert got == {(x, y) for x in patterns for y in texts if x and x in y}


def test_range_join_is_exact(spark):
    rng = random.Random(1)
    spans = [(i, a, a + rng.choice([0, 1, 3, 50, 4000])) for i, a in enumerate(rng.randrange(0, 500) for _ in range(60))]
    numbers = [(i, 100 if i % 3 == 0 else rng.randrange(0, 5000)) for i in range(90)] + [(999, None)]
    left = spark.createDataFrame(numbers, "p int, n long")
    right = spark.createDataFrame([*spans, (777, 5, 1)], "r int, lo long, hi long")
    got = [(x["p"], x["r"]) for x in ranges.range_join(left, right, "n", "lo", "hi").collect()]
    want = [(p, r) for p, n in numbers for r, lo, hi in spans if n is not None and lo <= n <= hi]
    assert sorted(got) == sorted(want)


def test_range_join_uses_all_tasks(spark):
    points = spark.range(0, 2000, 1, 1)
    held = spark.range(0, 10, 1, 1).select(F.col("id").alias("low"), (F.col("id") + 500).alias("high"))
    joined = ranges.range_join(points, held, "id", "low", "high")
    assert joined.count() == 10 * 501
    assert joined.select(F.spark_partition_id()).distinct().count() > 1


def test_pairs_of_a_range_join_are_stored_in_few_bytes(spark, tmp_path):
    """Pairs outgrow both sides, so it counts in which order they are stored."""
    points = spark.range(0, 2000, 1, 1).select("id", F.pmod(F.xxhash64("id"), F.lit(10)).alias("n"))
    held = spark.range(0, 4000, 1, 1).select(F.xxhash64("id").alias("r"), (F.col("id") % 10).alias("low"), (F.col("id") % 10 + 9).alias("high"))
    pairs = ranges.range_join(points, held, "n", "low", "high")
    assert pairs.columns == ["id", "n", "r", "low", "high"]
    pairs.write.parquet(f"file:{tmp_path}/pairs")
    what = [F.count(F.lit(1)), F.sum(F.xxhash64(*pairs.columns).cast("decimal(38,0)"))]
    stored = spark.read.parquet(f"file:{tmp_path}/pairs").agg(*what).first()
    assert stored == points.join(held, F.col("n").between(F.col("low"), F.col("high"))).select(*pairs.columns).agg(*what).first()
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < stored[0] / 2  # 0.2 bytes a pair; 1.5 when one point comes after another


def test_facets_skip_steps_that_leave_nothing(spark):
    lookup = spark.createDataFrame(
        [(2025, "V6H2J4", "LAND", "D1"), (2025, "V6H2J4", "STRATA", "D2"), (2025, "V6H9Z9", "STRATA", "D1"),
         (2025, "K1A0B1", "LAND", None), (2026, "K1A0B1", "LAND", "D3"), (2026, "Unknown", "LAND", "D4")],
        "y int, pc string, legal string, zone string",
    )
    asked = spark.createDataFrame(
        [(1, "v6h-2j4", " land ", "D2", 2025), (2, "V6H 1A1", "strata", None, 2025), (3, "Z9Z", "none", "d1", 2025), (4, None, None, None, 1999), (5, "", "LAND", "d3", None), (6, "unk", "", "", 2026)],
        "request_id int, property_postal_code string, legal string, zone string, report_year int",
    )
    contexts, options = facets.faceted_options(
        asked, lookup, "request_id", "y", "pc", {"legal": "legal", "zone": "zone"}, F.lit(2026), {"legal": 5, "zone": 1}
    )
    got = {r["request_id"]: (r["used_year"], r["postal_match_mode"], r["context_row_count"]) for r in contexts.collect()}
    assert got == {1: (2025, "exact", 1), 2: (2025, "fsa", 2), 3: (2025, "none", 2), 4: (None, "none", 6), 5: (2026, "none", 1), 6: (2026, "none", 2)}
    arrays = {(r["request_id"], r["facet"]): r["options"] for r in facets.options_as_arrays(options, "request_id").collect()}
    assert arrays[(1, "zone")] == ["D1"] and arrays[(2, "legal")] == ["STRATA"]
    assert arrays[(3, "legal")] == ["LAND", "STRATA"]
    assert arrays[(4, "legal")] == ["LAND", "STRATA"] and arrays[(4, "zone")] == ["D1"]


def test_option_matching(spark):
    options = spark.createDataFrame([("HA-2",), ("HA-3",), ("LAND",), ("Land Use",), ("RS  1",)], "o string")
    asked = spark.createDataFrame([(1, "land"), (2, "ha"), (3, " ha-3"), (4, "rs 1 "), (5, "land u"), (6, "zz"), (7, "")], "request_id int, t string")
    got = {r["request_id"]: (r["matched"], r["match_mode"]) for r in requests.match_options(asked, options, "request_id", "t", "o").collect()}
    assert got == {1: ("LAND", "exact"), 2: (None, "none"), 3: ("HA-3", "exact"), 4: ("RS  1", "exact"), 5: ("Land Use", "prefix"), 6: (None, "none"), 7: (None, "none")}


def test_completion_falls_back_level_by_level(spark):
    lookup = spark.createDataFrame(
        [(2025, "1", 10.0, None, "a"), (2025, "1", 20.0, 1.0, "b"), (2025, "2", None, 5.0, "b"), (2024, "1", 100.0, 9.0, "c"), (2024, "3", 300.0, None, "c")],
        "REPORT_YEAR int, NEIGHBOURHOOD_CODE string, neigh_v double, plain double, word string",
    )
    asked = spark.createDataFrame([(1, 2025, "1"), (2, 2025, "2"), (3, 2024, "9"), (4, 1990, "1")], "request_id int, REPORT_YEAR int, NEIGHBOURHOOD_CODE string")
    out = completion.complete_features(asked, lookup, ["neigh_v", "plain"], ["word"], groups={"neigh_": "NEIGHBOURHOOD_CODE"})
    got = {r["request_id"]: (r["neigh_v"], r["plain"], r["word"]) for r in out.collect()}
    assert got == {1: (15.0, 3.0, "b"), 2: (15.0, 3.0, "b"), 3: (200.0, 9.0, "c"), 4: (60.0, 5.0, "b")}


def test_request_rules(spark):
    df = spark.createDataFrame([("1990", "2026", None), ("1700", None, "2027"), ("x", "2019", "1980"), ("2025", "2024", "1990")], "b string, r string, i string")
    bad = requests.errors(requests.year_rules("b", "r", "i", 2020, 2026))
    assert [r[0] for r in df.select(bad).collect()] == [
        [],
        ["YEAR_BUILT_out_of_range", "BIG_IMPROVEMENT_YEAR_out_of_range"],
        ["YEAR_BUILT_not_a_year", "REPORT_YEAR_out_of_range"],
        ["YEAR_BUILT_out_of_range", "REPORT_YEAR_before_built", "BIG_IMPROVEMENT_YEAR_before_built"],
    ]


def test_short_patterns_meet_their_own_place_only(spark):
    from cadastra.operators.addresses import containing_texts

    streets = [f"{chr(65 + i % 26)}{i} ST" for i in range(300)]
    texts = spark.createDataFrame([(i % 100, s) for i, s in enumerate(streets)], "place int, street string")
    asked = spark.createDataFrame([(p, t) for p in (1, 2) for t in ("S", "ST", "A", "1")], "place int, text string")
    got = {tuple(r) for r in containing_texts(asked, "text", texts, "street", ["place"]).collect()}
    assert got == {(p, t, s) for p in (1, 2) for t in ("S", "ST", "A", "1") for i, s in enumerate(streets) if i % 100 == p and t in s}


def test_only_asked_prefixes_are_listed(spark):
    from cadastra.operators.requests import match_options

    options = spark.createDataFrame([("f", "Alpha One"), ("f", "Alpha Two"), ("g", "Beta")], "field string, option string")
    asked = spark.createDataFrame([(1, "f", "alpha"), (2, "f", "ALPHA  o"), (3, "g", "b"), (4, "g", ""), (5, "f", "alpha one"), (6, "g", None), (7, "f", "x")], "id int, field string, text string")
    got = {r["id"]: (r["matched"], r["match_mode"]) for r in match_options(asked, options, "id", "text", "option", ["field"]).collect()}
    assert got == {
        1: (None, "none"), 2: ("Alpha One", "prefix"), 3: ("Beta", "prefix"), 4: ("Beta", "prefix"), 5: ("Alpha One", "exact"), 6: ("Beta", "prefix"), 7: (None, "none"),
    }
