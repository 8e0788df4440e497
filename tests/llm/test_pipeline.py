from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from cadastra.session import stage

SF = "/root/testdata/sf0.001"


def test_stages_against_their_operators(spark):
    """Each stage keeps the rows that a plain reading of its operator's result names."""
    from cadastra.llm.exact_dedup import dedup
    from cadastra.llm.mixing import mix
    from cadastra.llm.ngram_join import similar_groups
    from cadastra.llm.resampling import resample

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_duplicates", "near_duplicates", "source_mix", "tokens"]
    decided = {
        "quality": lambda d: [r.doc_id for r in resample(d, labels).collect()],
        "exact_duplicates": lambda d: [r.doc_id for r in dedup(d).where("kept").collect()],
        "near_duplicates": lambda d: [r.doc_id for r in similar_groups(d).collect() if r.component_id == r.doc_id],
        "source_mix": lambda d: [r.doc_id for r in mix(d).collect() for _ in range(r.taken // r["size"] if r["size"] else 0)],
    }
    for name, function in corpus_pipeline.STAGES:
        out = stage(function(spark, docs, SF))
        if name in decided:
            assert out.columns == docs.columns
            assert sorted(r.doc_id for r in out.collect()) == sorted(decided[name](docs))
        else:
            assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in docs.collect())
        docs = out
    assert docs.where(F.size("ids") != F.col("n_tokens")).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_bear_odd_rows(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, None, None, None, None), (10**9 + 1, "", "en", None, 0)], docs.schema)
    function = dict(corpus_pipeline.STAGES)[name]
    assert function(spark, docs.unionByName(odd), SF).count() > 0
    assert function(spark, docs.limit(0), SF).count() == 0


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    rows = [(3, "same  text"), (5, "own text"), (5, "same text"), (5, "own\ttext"), (7, None), (8, ""), (None, "same text"), (None, "no id"), (None, "no id")]
    table = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], docs.schema))
    got = corpus_pipeline.exact_duplicates(spark, table, SF).select("doc_id", "text").collect()
    assert sorted((str(i), str(t)) for i, t in got) == sorted([("3", "same  text"), ("5", "own\ttext"), ("7", "None"), ("None", "no id")])


def test_the_entry_works_without_the_subpackage():
    """A library that only the subpackage needs is missing: its queries are left out and the others stay."""
    import subprocess
    import sys

    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); assert 'clean_fact' in q and 'pipeline' not in q and not any(n.startswith('op1') for n in q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0])
