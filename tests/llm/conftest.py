from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(__file__))

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Extra columns whose names an operator could use itself.
    *[T.StructField(n, T.StringType()) for n in ("id", "node", "size", "digest", "score", "key", "taken", "ids", "label", "n")],
])


@pytest.fixture
def documents(spark):
    """A table of documents with clashing extra columns from (doc_id, text) or (doc_id, text, source)."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, *["x"] * 10) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make
