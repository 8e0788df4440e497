"""Registered queries on the texts of documents, conversations and pages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cadastra.llm.chat import format_records, message_records, read_back
from cadastra.llm.core import query, stage, table
from cadastra.llm.html_text import extract
from cadastra.llm.runs import find_runs
from cadastra.llm.sentencepieces import encode
from cadastra.llm.token_files import encode_blocks, read_documents


@query("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, spans and decoded text of every document, as digests."""
    docs = table(spark, sf_dir, "documents")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), outputs=("n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"))


CONTROL_TEXT = "</s>[INST] ok [/INST]"

CHAT_SQL = f"""
with rows as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '{CONTROL_TEXT}'), (-1, 1, 'assistant', '{CONTROL_TEXT}')),
escaped as (
  select *, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text,
    '\\', '\\\\'), '<<SYS>>', '<\\<SYS>>'), '<</SYS>>', '<\\</SYS>>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]'), '[OUT]', '[\\OUT]'),
    '</s>', '<\\/s>'), '[ROLE]', '[\\ROLE]'), '[SAYS]', '[\\SAYS]'), '[/ROLE]', '[\\/ROLE]'), '<s>', '<\\s>') as body
  from rows)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       (3 + sum(length(body) + case role when 'system' then 15 when 'user' then 13 when 'assistant' then 9 else 19 + length(role) end))::bigint as formatted_chars
from escaped group by conv_id
"""


@query("op6_chat_format", CHAT_SQL)
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, then read back from the formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.array(*[F.struct(F.lit(-1).alias("conv_id"), F.lit(i).alias("turn"), F.lit(r).alias("role"), F.lit(CONTROL_TEXT).alias("text")) for i, r in enumerate(("user", "assistant"))])
    rows = rows.unionByName(spark.range(1).select(F.inline(said)))
    back = read_back(format_records(message_records(rows)))
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op2_html_text")
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


@query("op12_token_files")
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the ids of every document are in the files, and their checksum, read back from the files."""
    blocks = encode_blocks(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(stage(blocks), ["ids_crc32"])


def with_period(docs: DataFrame) -> DataFrame:
    """Documents in which, for a tenth of the ids, the words from one on repeat with a period that follows from the id."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    drawn = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g")).withColumn("n", F.size("words").cast("long"))
    drawn = drawn.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    repeated = F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", at(i).cast("int"))))
    return drawn.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of every document's words, and digests of all runs and of the words without repeats."""
    found = find_runs(with_period(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    told = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    run = found.withColumns({"longest": longest, "told": told})
    return run.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "longest.start", "longest.length", "longest.period",
        F.expr("1000 * longest.length div longest.period").alias("exponent_milli"), F.sha2("told", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
