"""Registered queries that find copies and near copies among documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadastra.llm.core import query, table
from cadastra.llm.exact_dedup import dedup
from cadastra.llm.ngram_join import similar_groups

EXACT_SQL = r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, text_sha256
from t window w as (partition by text_sha256)
"""


@query("op8_exact_dedup", EXACT_SQL)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays for every document."""
    return dedup(table(spark, sf_dir, "documents"))


@query("op7_ngram_jaccard_join")
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near copies of every document."""
    return similar_groups(table(spark, sf_dir, "documents"))
