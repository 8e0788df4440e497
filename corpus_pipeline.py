"""From raw documents to the tokens of a training mix, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns the columns of documents, but for the last, which returns the
encoded documents. ``run`` writes each stage as Parquet in the shared folder and
reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cadastra.llm.exact_dedup import dedup, normalised
from cadastra.llm.mixing import mix
from cadastra.llm.ngram_join import similar_groups
from cadastra.llm.resampling import resample
from cadastra.llm.sentencepieces import encode
from cadastra.session import stage

#: The columns of documents; a stage adds none.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _kept(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is among ``ids``; rows without an id have no decision and go."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance; those unlike the labelled good ones go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _kept(docs, resample(docs, labels))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays; rows with one id and different texts are judged each on its own text.

    Rows that share id and text are one, the smallest by their columns. A row
    without an id stays where no row with an id has its text.
    """
    kept = dedup(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest")).distinct()
    marked = docs.withColumn("_digest", F.sha2(normalised(F.col("text")), 256))
    first = F.row_number().over(Window.partitionBy("doc_id", "_digest").orderBy(*[c for c in docs.columns if c != "doc_id"]))
    single = marked.withColumn("_at", first).where(F.col("_at") == 1)
    return single.join(kept.withColumnRenamed("_digest", "_kept"), (F.col("_digest") == F.col("_kept")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies stays."""
    return _kept(docs, similar_groups(docs).where(F.col("component_id") == F.col("doc_id")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    times = mix(docs).where("taken > 0").select("doc_id", (F.col("taken") / F.col("size")).cast("int").alias("times"))
    taken = docs.join(times, "doc_id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return taken.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and original byte spans of every document of the mix."""
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), outputs=("ids", "span_starts", "span_ends", "n_tokens"))


STAGES = [
    ("quality", quality),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: SQL can't express the trained weights, the knapsack and the encoder; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES:
        docs = stage(function(spark, docs, sf_dir))
    return docs
