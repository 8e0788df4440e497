"""Scoring of request files as they arrive, with Structured Streaming.

Nothing is kept between requests, so there is no state and no watermark: the
files of a folder are the stream, model, completion values and errors are static
tables. Spark's checkpoint remembers which files are done and its file sink which
results are committed, so every request is answered once, also after a restart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

FILES_PER_BATCH = 64


def request_stream(spark: SparkSession, folder: str, schema: str | T.StructType, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """The Parquet files of a folder as a stream; ``files_per_batch`` of them are read at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def score_arrived(
    spark: SparkSession, folder: str, schema: str | T.StructType, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
    files_per_batch: int = FILES_PER_BATCH,
) -> StreamingQuery:
    """Score all files that have arrived since the last call, append the results to ``out`` and end.

    ``score`` takes and returns a streaming table, such as ``scoring.score_requests``.
    """
    scored = score(request_stream(spark, folder, schema, files_per_batch))
    query = scored.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return query
