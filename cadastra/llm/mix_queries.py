"""Registered query that mixes the sources of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadastra.llm.core import query, table
from cadastra.llm.mixing import mix


@query("op9_mix_sources")
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document, with sources weighing 1, 2, 3 in turn."""
    return mix(table(spark, sf_dir, "documents"))
