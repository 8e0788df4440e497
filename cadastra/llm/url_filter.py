"""URL filters: rules on host and path, looked up in Bloom filter cascades.

A cascade is built for a known universe of keys, here every key that any URL of
the corpus could be looked up by. Its first filter holds the listed keys, the
second the universe's keys that pass the first by mistake, the third the listed
keys that pass the second, and so on until no mistake is left. For keys of the
universe, membership is then exact, and a URL is judged from a few bit arrays
without a join. All of it is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cadastra.session import stage

HASHES = 4
BITS_PER_KEY = 10


@dataclass(frozen=True)
class Level:
    """One Bloom filter: a one-row table of its 64-bit words, and its size."""

    words: DataFrame
    n_bits: int
    number: int

    def contains(self, key: Column) -> Column:
        words = self.words.scalar()
        hit = F.lit(True)
        for bit in _bits(key, self.number, self.n_bits):
            word = F.get(words, F.shiftright(bit, 6).cast("int"))
            hit = hit & (word.bitwiseAND(_mask(bit)) != 0)
        return hit


def _bits(key: Column, number: int, n_bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(number * HASHES + i)), F.lit(n_bits).cast("long")) for i in range(HASHES)]


def _mask(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))


def bloom_level(keys: DataFrame, number: int, n_keys: int, most_bits: int | None = None) -> Level:
    """A filter of ``BITS_PER_KEY`` bits a key, or ``most_bits``; bits meet as 64-bit words, combined before the shuffle."""
    n_bits = -(-min(max(1, n_keys) * BITS_PER_KEY, most_bits or 1 << 62) // 64) * 64
    bit = F.explode(F.array(*_bits(F.col("key"), number, n_bits)))
    words = keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(_mask(F.col("bit"))).alias("word"))
    filled = F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(n_bits // 64 - 1).cast("long")),
        lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0).cast("long")),
    )
    entries = F.map_from_entries(F.collect_list(F.struct("at", "word")))
    return Level(stage(words.agg(entries.alias("m")).select(filled.alias("words"))), n_bits, number)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe the cascade was built on."""
        answer = F.lit(False)
        for level in reversed(self.levels):
            answer = level.contains(key) & ~answer
        return answer


def build_cascade(keys: DataFrame, listed: str = "listed") -> Cascade:
    """From distinct ``key`` and whether it is listed. Without a listed key, nothing is a member.

    Each level costs one pass over the side of the universe that could pass by
    mistake; what passed is staged, and shrinks by the filter's error rate.
    """
    levels: list[Level] = []
    here, there = keys.where(F.col(listed)).select("key"), keys.where(~F.col(listed)).select("key")
    n_keys = here.count()
    while n_keys:
        level = bloom_level(here, len(levels), n_keys)
        levels.append(level)
        here, there = stage(there.where(level.contains(F.col("key")))), here
        n_keys = here.count()
    return Cascade(tuple(levels))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or a text without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def candidate_keys(host: Column, path: Column, labels: Sequence[int], lengths: Sequence[int]) -> list[Column]:
    """Every key a URL may be listed under: its last ``labels`` host labels and the first ``lengths`` characters of its path.

    One column for each kind of key, null where the URL is too short for it.
    """
    parts = F.size(F.split(host, r"\."))
    return [
        F.when((parts >= n) & (F.length(path) >= m), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, m)))
        for n in labels for m in lengths
    ]


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) given as values."""
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
    return spark.range(1).select(F.inline(rows))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col``, host, path, rule and verdict of every row.

    A rule fits its host and all subdomains of it, where the path begins with
    the rule's path. The longest rule that fits decides (of one that is listed
    both ways, block). Without a rule, a URL is not listed and so allowed. A
    null URL, or one without ``://``, has an empty host and path. Null parts of a
    rule count as empty. Rows are kept as they are, repeated and null ids too.
    """
    listed = stage(rules.select(F.concat(F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))).alias("key"), "host", "path", F.col("verdict") == "block"
                   ).toDF("key", "host", "path", "blocks"))
    shape = listed.agg(
        F.collect_set(F.size(F.split(F.coalesce("host", F.lit("")), r"\."))).alias("labels"), F.collect_set(F.length(F.coalesce("path", F.lit("")))).alias("lengths")
    ).first()
    host, path = split_url(pages[f"`{url_col}`"])
    urls = pages.select(pages[f"`{id_col}`"].alias("id"), host.alias("host"), path.alias("path"))
    keys = candidate_keys(F.col("host"), F.col("path"), sorted(shape["labels"]) or [1], sorted(shape["lengths"]) or [0])
    names = [f"key{i}" for i in range(len(keys))]
    seen = urls.select(F.explode(F.array_compact(F.array(*keys))).alias("key")).select("key", F.lit(None).cast("boolean").alias("blocks"))
    universe = stage(
        seen.unionByName(listed.select("key", "blocks")).groupBy("key").agg(
            F.coalesce(F.max("blocks"), F.lit(False)).alias("block"), F.coalesce(F.max(~F.col("blocks")), F.lit(False)).alias("allow"))
    )
    block = build_cascade(universe, "block")
    allow = build_cascade(universe, "allow")

    def longest(cascade: Cascade) -> Column:
        fits = [F.when(F.col(n).isNotNull() & cascade.contains(F.col(n)), F.struct(F.length(n).alias("n"), F.col(n).alias("key"))) for n in names]
        return F.array_max(F.array(*fits))

    keyed = urls.select("*", *[k.alias(n) for k, n in zip(keys, names)])
    best = keyed.select("id", "host", "path", longest(block).alias("b"), longest(allow).alias("a"))
    blocked = F.coalesce(F.col("b.n"), F.lit(-1)) >= F.coalesce(F.col("a.n"), F.lit(0))
    return best.select(
        F.col("id").alias(id_col), "host", "path",
        F.when(blocked, F.col("b.key")).otherwise(F.col("a.key")).alias("rule"),
        F.when(blocked, "block").otherwise("allow").alias("verdict"),
    )
