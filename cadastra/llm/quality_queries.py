"""Registered queries that judge documents by models trained here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cadastra.llm.core import query, table
from cadastra.llm.resampling import resample
from cadastra.llm.toxicity import score


@query("op3_importance_resampling")
def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn as like the ones labelled good."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, and how many of its sentences offend."""
    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("offending").cast("long").alias("n_offending"))
