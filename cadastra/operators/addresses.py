"""Address table and tiered address resolution for a table of requests.

A request names a house number and a street, and perhaps a postal code and a
year. Rows whose number range holds the number are narrowed to the exact
street, else to streets that contain the text, else kept; then to the exact
postal code, else to its first three characters, else kept; the first few are
returned. All requests are resolved at once and by equality joins only: number
ranges are cut into aligned blocks, and a stored index keeps the first few rows
of every block, street and postal area. Batches of requests read the index by its
buckets; the addresses themselves are read once, when it is built.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cadastra.functions.civic import civic_int, civic_number, display_address, range_high, range_low
from cadastra.functions.numbers import number_of
from cadastra.functions.postal import lookup_fsa, lookup_postal
from cadastra.functions.text import street_name, strip_ws
from cadastra.operators.checks import require_columns
from cadastra.operators.facets import ALL_YEARS
from cadastra.operators.ranges import number_blocks, range_blocks, top_level
from cadastra.operators.requests import errors
from cadastra.session import shared_folder, shuffled, stage
from cadastra.sources.delimited import optional_column

DEFAULT_LIMIT = 10
#: Candidates that a request may ask for.
MAX_LIMIT = 20

# Columns of the address source, and those that tell candidates apart.
ADDRESS_REQUIRED = [
    "REPORT_YEAR",
    "PROPERTY_POSTAL_CODE",
    "STREET_NAME",
    "LEGAL_TYPE",
    "ZONING_DISTRICT",
    "ZONING_CLASSIFICATION",
    "NEIGHBOURHOOD_CODE",
    "YEAR_BUILT",
]
CIVIC_COLUMNS = ["FROM_CIVIC_NUMBER", "TO_CIVIC_NUMBER"]
CANDIDATE_COLUMNS = [
    "DISPLAY_ADDRESS",
    "PROPERTY_POSTAL_CODE",
    "LEGAL_TYPE",
    "ZONING_DISTRICT",
    "ZONING_CLASSIFICATION",
    "NEIGHBOURHOOD_CODE",
    "YEAR_BUILT",
    "BIG_IMPROVEMENT_YEAR",
    "REPORT_YEAR",
]


def address_table(raw: DataFrame, row_id: str | None = None) -> DataFrame:
    """Rows usable for lookup, with normalised columns and a display address.

    ``row_id`` orders rows that are otherwise alike; without it they are
    ordered by their texts.
    """
    require_columns(raw, ADDRESS_REQUIRED, "address source")
    if not [c for c in CIVIC_COLUMNS if c in raw.columns]:
        raise ValueError(f"address source needs at least one of {CIVIC_COLUMNS}")
    texts = [c for c in ADDRESS_REQUIRED if c not in ("REPORT_YEAR", "YEAR_BUILT")]
    improved = number_of(raw, "BIG_IMPROVEMENT_YEAR") if "BIG_IMPROVEMENT_YEAR" in raw.columns else F.lit(None)
    rows = raw.select(
        *([F.col(row_id).alias("ROW_ID")] if row_id else []),
        number_of(raw, "REPORT_YEAR").try_cast("int").alias("REPORT_YEAR"),
        number_of(raw, "YEAR_BUILT").try_cast("int").alias("YEAR_BUILT"),
        improved.cast("double").try_cast("int").alias("BIG_IMPROVEMENT_YEAR"),
        *[F.coalesce(strip_ws(c), F.lit("")).alias(c) for c in texts],
        *[civic_number(optional_column(raw, c)).alias(c) for c in CIVIC_COLUMNS],
    )
    first, last = CIVIC_COLUMNS
    kept = rows.where(
        F.col("REPORT_YEAR").isNotNull()
        & F.col("YEAR_BUILT").isNotNull()
        & (F.length("PROPERTY_POSTAL_CODE") > 0)
        & (F.length("STREET_NAME") > 0)
        & ((F.length(first) > 0) | (F.length(last) > 0))
    )
    return kept.withColumns(
        {
            "POSTAL_CODE_NORMALIZED": lookup_postal("PROPERTY_POSTAL_CODE"),
            "POSTAL_FSA": F.substring(lookup_postal("PROPERTY_POSTAL_CODE"), 1, 3),
            "STREET_NAME_NORMALIZED": street_name("STREET_NAME"),
            "CIVIC_LOW": range_low(civic_int(first), civic_int(last)),
            "CIVIC_HIGH": range_high(civic_int(first), civic_int(last)),
            "DISPLAY_ADDRESS": display_address(first, last, "STREET_NAME", "PROPERTY_POSTAL_CODE"),
        }
    )


def containing_texts(patterns: DataFrame, pattern: str, texts: DataFrame, text: str, on: list[str] | None = None) -> DataFrame:
    """(pattern, text) pairs where the distinct text contains the distinct pattern and the columns ``on`` agree.

    Texts are indexed by their grams of one to three characters; a pattern
    looks up its rarest gram and only those texts are compared. With ``on``, a
    short pattern meets only the texts of its own place.
    """
    on = on or []
    lengths = F.array(*[F.lit(i) for i in (1, 2, 3)])

    def grams(col: str, sizes: Column) -> Column:
        starts = lambda k: F.filter(F.sequence(F.lit(1), F.length(col)), lambda i: i + k - 1 <= F.length(col))
        return F.array_distinct(
            F.flatten(F.transform(sizes, lambda k: F.transform(starts(k), lambda i: F.substr(F.col(col), i, k))))
        )

    places = texts.select(*on, text).distinct().where(F.length(text) > 0)
    spelt = stage(places.select(text).distinct().withColumn("_gram", F.explode(grams(text, lengths))))
    frequency = spelt.groupBy("_gram").agg(F.count(F.lit(1)).alias("_texts"))
    asked = patterns.select(*on, pattern).distinct().where(F.length(pattern) > 0)
    longest = F.array(F.least(F.length(pattern), F.lit(3)))
    split = asked.select(pattern).distinct().withColumn("_gram", F.explode(grams(pattern, longest)))
    # A gram no text has rules the pattern out; otherwise take the rarest.
    rarest = (
        split.join(shuffled(frequency), "_gram", "left")
        .groupBy(pattern)
        .agg(F.min_by("_gram", F.struct(F.coalesce("_texts", F.lit(0)), "_gram")).alias("_gram"))
    )
    rarest = stage(rarest)
    # Texts are listed in their places under the grams that some pattern looks up only.
    looked_up = spelt.join(shuffled(rarest.select("_gram").distinct()), "_gram", "left_semi")
    indexed = places.join(shuffled(looked_up), text)
    pairs = asked.join(shuffled(rarest), pattern).join(shuffled(indexed), [*on, "_gram"])
    return pairs.where(F.contains(F.col(text), F.col(pattern))).select(*on, pattern, text)


def _postal_scopes(postal: Column, fsa: Column) -> Column:
    """Postal areas, most precise first."""
    areas = [postal, fsa, F.lit("")]
    return F.array(*[F.struct(F.lit(i).alias("scope"), a.alias("area")) for i, a in enumerate(areas)])


@dataclass
class AddressIndex:
    """A stored index: candidate ``rows`` by ROW_ID, the first rows of every place, and the streets of every node.

    A node is a year and an aligned block of house numbers; a place is a node
    with a street (or any) and a postal area (or any). It keeps as many row ids
    as a request may ask for.
    """

    rows: DataFrame
    places: DataFrame
    streets: DataFrame
    years: list[int]
    top: int
    max_limit: int


NODE = ["_year", "level", "block"]
PLACE = [*NODE, "any_street", "street", "scope", "area"]
#: Tables of the index and the columns they are bucketed by.
BUCKETS = {"rows": ["ROW_ID"], "places": PLACE, "streets": NODE}


def _candidate_rows(addresses: DataFrame) -> DataFrame:
    """Rows with a number range; those that differ in their keys only share the smallest ROW_ID."""
    keys = ["CIVIC_LOW", "CIVIC_HIGH", "STREET_NAME_NORMALIZED", "POSTAL_CODE_NORMALIZED", "POSTAL_FSA"]
    usable = addresses.where(F.col("CIVIC_LOW").isNotNull())
    if "ROW_ID" in addresses.columns:
        rows = usable.groupBy(*CANDIDATE_COLUMNS, *keys).agg(F.min("ROW_ID").alias("ROW_ID"))
    else:
        rows = usable.select(*CANDIDATE_COLUMNS, *keys).distinct().orderBy(*CANDIDATE_COLUMNS, *keys)
        rows = rows.withColumn("ROW_ID", F.monotonically_increasing_id())
    return stage(rows.withColumn("ROW_ID", F.min("ROW_ID").over(Window.partitionBy(*CANDIDATE_COLUMNS))))


def _places(rows: DataFrame, max_limit: int) -> DataFrame:
    """The first ``max_limit`` row ids of every place; tasks drop the others before anything is shuffled."""
    placed = range_blocks(rows.withColumn("_year", F.col("REPORT_YEAR")), "CIVIC_LOW", "CIVIC_HIGH")
    streets = F.array(F.struct(F.lit(False).alias("any_street"), F.col("STREET_NAME_NORMALIZED").alias("street")),
                      F.struct(F.lit(True).alias("any_street"), F.lit("").alias("street")))
    placed = placed.withColumn("_s", F.explode(streets)).select("*", "_s.*").drop("_s")
    scopes = _postal_scopes(F.col("POSTAL_CODE_NORMALIZED"), F.col("POSTAL_FSA"))
    placed = placed.withColumn("_p", F.explode(scopes)).select("*", "_p.*").drop("_p")
    rank = F.dense_rank().over(Window.partitionBy(*PLACE).orderBy("ROW_ID"))  # a row that lies twice in a place has one rank
    first = placed.select(*PLACE, "ROW_ID").withColumn("_at", rank).where(F.col("_at") <= max_limit)
    return first.groupBy(*PLACE).agg(F.sort_array(F.collect_set("ROW_ID")).alias("ids"))


def _table_name(path: str) -> str:
    return "addresses_" + hashlib.md5(path.encode()).hexdigest()


def write_address_index(addresses: DataFrame, path: str, max_limit: int = MAX_LIMIT) -> None:
    """Build and store the index, bucketed as ``BUCKETS`` says and sorted in the buckets.

    There are as many buckets as shuffle partitions, so that the rows of a bucket
    are in one task already when they are written.
    """
    spark = addresses.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _candidate_rows(addresses)
    years = sorted(r[0] for r in addresses.select(F.col("REPORT_YEAR").cast("int")).distinct().collect() if r[0] is not None)
    blocks = range_blocks(rows.select(F.col("REPORT_YEAR").alias("_year"), F.col("STREET_NAME_NORMALIZED").alias("street"), "CIVIC_LOW", "CIVIC_HIGH"), "CIVIC_LOW", "CIVIC_HIGH")
    tables = {
        "rows": rows.select("ROW_ID", *CANDIDATE_COLUMNS).groupBy("ROW_ID").agg(*[F.any_value(c).alias(c) for c in CANDIDATE_COLUMNS]),
        "places": _places(rows, max_limit),
        "streets": blocks.select(*NODE, "street").distinct().repartition(buckets, *NODE),
    }
    schemas = {}
    for name, df in tables.items():
        table = _table_name(f"{path}/{name}")
        spark.sql(f"drop table if exists {table}")
        df.write.mode("overwrite").bucketBy(buckets, *BUCKETS[name]).sortBy(*BUCKETS[name]).option("path", f"{path}/{name}").saveAsTable(table)
        schemas[name] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    facts = {"years": years, "top": top_level(rows, "CIVIC_LOW", "CIVIC_HIGH"), "max_limit": max_limit, "buckets": buckets, "schemas": schemas}
    spark.createDataFrame([facts], FACTS).write.mode("overwrite").json(f"{path}/facts")


FACTS = "years array<int>, top int, max_limit int, buckets int, schemas map<string, string>"


def open_address_index(spark: SparkSession, path: str) -> AddressIndex:
    """The index of an earlier run, its buckets known to the optimizer in any session."""
    facts = spark.read.schema(FACTS).json(f"{path}/facts").first()
    for name, keys in BUCKETS.items():
        by = ", ".join(keys)
        spark.sql(
            f"create table if not exists {_table_name(f'{path}/{name}')} ({facts['schemas'][name]}) using parquet "
            f"clustered by ({by}) sorted by ({by}) into {facts['buckets']} buckets location '{path}/{name}'"
        )
    tables = {name: spark.table(_table_name(f"{path}/{name}")) for name in BUCKETS}
    return AddressIndex(**tables, years=list(facts["years"]), top=facts["top"], max_limit=facts["max_limit"])


def address_index(addresses: DataFrame, max_limit: int = MAX_LIMIT) -> AddressIndex:
    """An index among the stages, for a table that is asked once."""
    spark = addresses.sparkSession
    path = f"{shared_folder(spark)}/address-index-{uuid.uuid4().hex}"
    write_address_index(addresses, path, max_limit)
    return open_address_index(spark, path)


def _of_years(index: AddressIndex, wanted: DataFrame) -> DataFrame:
    """``wanted`` with the years to look in: its own, or all of the index; the asked one stays as ``_asked``."""
    every = F.array(*[F.lit(y) for y in index.years]).cast("array<int>")
    years = F.when(F.col("_asked") == ALL_YEARS, every).otherwise(F.array("_asked"))
    return wanted.withColumnRenamed("_year", "_asked").withColumn("_year", F.explode(years))


def asked_streets(index: AddressIndex, nodes: DataFrame) -> DataFrame:
    """The streets of the asked nodes; the index is read by its buckets, only the nodes move."""
    held = index.streets.join(shuffled(_of_years(index, nodes)), NODE)
    return held.select(F.col("_asked").alias("_year"), "level", "block", "street").distinct()


def asked_places(index: AddressIndex, places: DataFrame) -> DataFrame:
    """The row ids of the asked places; a place of all years has the first ones of every year's."""
    held = index.places.join(shuffled(_of_years(index, places)), PLACE).withColumn("_year", F.col("_asked"))
    own = held.where(F.col("_year") != ALL_YEARS).select(*PLACE, "ids")
    merged = held.where(F.col("_year") == ALL_YEARS).groupBy(*PLACE).agg(F.flatten(F.collect_list("ids")).alias("ids"))  # one list a year
    return own.unionByName(merged.withColumn("ids", F.slice(F.sort_array("ids"), 1, index.max_limit)))


def limit_errors(requests: DataFrame, max_limit: int = MAX_LIMIT, request_id: str = "request_id") -> DataFrame:
    """Requests that ask for fewer than one or more than ``max_limit`` candidates, with the reason."""
    bad = ~F.coalesce(F.col("limit").cast("int"), F.lit(DEFAULT_LIMIT)).between(1, max_limit)
    return requests.select(request_id, errors({"limit_out_of_range": bad}).alias("errors")).where(F.size("errors") > 0)


def resolve_addresses(
    requests: DataFrame,
    addresses: DataFrame | AddressIndex,
    default_year: Column,
    request_id: str = "request_id",
    max_limit: int = MAX_LIMIT,
) -> DataFrame:
    """Candidates per request: rank, the match modes, and the candidate columns.

    ``addresses`` is a stored index, or a table that one is made of first, with
    ``max_limit`` rows for each place. A request gets as many candidates as its
    ``limit`` (``DEFAULT_LIMIT`` without one). One whose limit is out of range is
    refused: it gives no row here but one in ``limit_errors``. Requests without
    a candidate give no row; see ``lookup_outcome``.
    """
    index = addresses if isinstance(addresses, AddressIndex) else address_index(addresses, max_limit)
    wanted_year = F.coalesce(F.col("report_year").cast("int"), default_year).cast("int")
    asked = requests.withColumn("_asked_year", wanted_year).withColumn("_limit", F.coalesce(F.col("limit").cast("int"), F.lit(DEFAULT_LIMIT)))
    asked = stage(
        asked.where(F.col("_limit").between(1, index.max_limit)).select(
            request_id,
            "_limit",
            "_asked_year",
            F.when(F.col("_asked_year").isin(index.years), F.col("_asked_year")).otherwise(F.lit(ALL_YEARS)).alias("_year"),
            civic_int("street_number").alias("_number"),
            street_name("street_name").alias("_street"),
            lookup_postal("property_postal_code").alias("_postal"),
            lookup_fsa("property_postal_code").alias("_fsa"),
        )
    )
    query = ["_year", "_number", "_street", "_postal", "_fsa"]
    queries = asked.where(F.col("_number").isNotNull()).select(*query).distinct()
    node, place = NODE, PLACE
    spots = number_blocks(queries.select("_year", "_number").distinct(), "_number", index.top)
    known = stage(asked_streets(index, spots.select(*node).distinct()))
    spots = spots.join(shuffled(known.select(*node).distinct()), node, "left_semi")  # blocks without rows end here

    # The streets a query may use: exact, containing, any.
    nodes = stage(queries.join(shuffled(spots), ["_year", "_number"]))
    exact = nodes.withColumn("street", F.col("_street")).join(shuffled(known), [*node, "street"], "left_semi")
    exact = stage(exact.select(*query, "level", "block", "street", F.lit(0).alias("_tier")))
    rest = nodes.join(shuffled(exact.select(*query).distinct()), query, "left_anti")
    pairs = containing_texts(rest, "_street", known, "street", node)
    spelled = rest.select(*node, "_number", "_street").distinct().join(shuffled(pairs), [*node, "_street"])
    inside = queries.join(shuffled(spelled), ["_year", "_number", "_street"])
    inside = stage(inside.select(*query, "level", "block", "street", F.lit(1).alias("_tier")))
    loose = rest.join(shuffled(inside.select(*query).distinct()), query, "left_anti")
    loose = loose.select(*query, "level", "block", F.lit("").alias("street"), F.lit(2).alias("_tier"))
    ways = exact.unionByName(inside).unionByName(loose).withColumn("any_street", F.col("_tier") == 2)
    areas = _postal_scopes(F.col("_postal"), F.col("_fsa"))
    ways = ways.withColumn("_p", F.explode(areas)).select("*", "_p.*").drop("_p")
    ways = ways.where((F.col("scope") == 2) | (F.col("area") != ""))

    # The most precise postal area that holds rows, and the first of them.
    best = stage(asked_places(index, ways.select(*place).distinct()))
    per_query = Window.partitionBy(*query)
    held = ways.join(shuffled(best), place).withColumn("_best", F.min("scope").over(per_query)).where(F.col("scope") == F.col("_best"))
    hits = held.select(*query, "_tier", "scope", F.explode("ids").alias("ROW_ID"))
    ranked = hits.withColumn("candidate_id", F.row_number().over(per_query.orderBy("ROW_ID")))
    ranked = ranked.where(F.col("candidate_id") <= index.max_limit)

    # An empty text is inside every street, so it keeps all rows as a "contains" match.
    mode = F.when(F.col("_tier") == 0, "exact").when((F.col("_tier") == 1) | (F.col("_street") == ""), "contains").otherwise("none")
    ranked = stage(
        ranked.select(
            *query,
            "candidate_id",
            mode.alias("name_match_mode"),
            F.element_at(F.array(F.lit("exact"), F.lit("fsa"), F.lit("none")), F.col("scope") + 1).alias("postal_match_mode"),
            "ROW_ID",
        )
    )
    answered = asked.join(shuffled(ranked), query).where(F.col("candidate_id") <= F.col("_limit"))
    answered = index.rows.join(shuffled(answered), "ROW_ID")
    return answered.select(
        request_id,
        "candidate_id",
        F.col("_asked_year").alias("used_report_year"),
        (F.col("_year") == ALL_YEARS).alias("year_fallback"),
        "name_match_mode",
        "postal_match_mode",
        *[lookup_postal(c).alias(c) if c == "PROPERTY_POSTAL_CODE" else F.col(c) for c in CANDIDATE_COLUMNS],
    )


def lookup_outcome(requests: DataFrame, candidates: DataFrame, request_id: str = "request_id") -> DataFrame:
    """One row per request: number of candidates, and whether there is exactly one."""
    found = candidates.groupBy(request_id).agg(
        F.count(F.lit(1)).alias("match_count"), F.first("postal_match_mode").alias("postal_match_mode")
    )
    out = requests.select(request_id).join(shuffled(found), request_id, "left")
    count = F.coalesce("match_count", F.lit(0))
    return out.select(
        request_id,
        count.alias("match_count"),
        (count == 1).alias("auto_selected"),
        F.coalesce("postal_match_mode", F.lit("none")).alias("postal_match_mode"),
    )
