"""All queries of the subpackage, and the pipeline of its operators."""

from __future__ import annotations

import corpus_pipeline
from cadastra.llm import dedup_queries, mix_queries, quality_queries, text_queries, url_queries, vector_queries  # noqa: F401
from cadastra.llm.core import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

__all__ = ["ORACLES", "QUERIES"]
