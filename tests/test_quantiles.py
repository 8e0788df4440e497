"""Exact quantiles against numpy, on groups that are hot, tight, wide or tied."""

from __future__ import annotations

import numpy as np
import pytest

from cadastra.operators import quantiles
from cadastra.operators.sampling import hash_sample, sample_hash

PROBS = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p995": 0.995, "p1": 1.0}


def groups():
    rng = np.random.default_rng(5)
    return {
        "hot": rng.lognormal(12, 3, 4000),
        "tight": 1.0 + rng.random(300) * 1e-9,
        "ties": rng.integers(0, 3, 500).astype(float),
        "signed": rng.normal(0, 1e6, 301),
        "near zero": np.concatenate([10.0 ** -rng.uniform(4, 300, 3000), -(10.0 ** -rng.uniform(4, 300, 200))]),
        "tiny": np.array([3.0]),
        "pair": np.array([-1.0, 2.0]),
        None: rng.random(50),
    }


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, float(v)) for k, values in groups().items() for v in values]
    rows += [("hot", None), ("empty", None)]
    return spark.createDataFrame(rows, "k string, v double").repartition(8)


def test_quantiles_match_numpy(table):
    out = quantiles.exact_quantiles(table, ["k"], "v", PROBS, count="n")
    got = {r["k"]: r for r in out.collect()}
    assert set(got) == set(groups())
    for k, values in groups().items():
        assert got[k]["n"] == len(values)
        for name, p in PROBS.items():
            assert got[k][name] == pytest.approx(np.percentile(values, 100 * p), rel=1e-12, abs=1e-320), (k, name)


def test_quantiles_without_keys(table):
    values = np.concatenate(list(groups().values()))
    row = quantiles.exact_quantiles(table, [], "v", PROBS).first()
    assert row["p50"] == pytest.approx(np.percentile(values, 50))
    assert row["p995"] == pytest.approx(np.percentile(values, 99.5))
    empty = table.where("false")
    assert quantiles.exact_quantiles(empty, [], "v", PROBS).count() == 0


def test_infinite_values_are_values(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", float("inf")), ("b", float("-inf")), ("b", 4.0), ("b", 4.0)]
    out = quantiles.exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"low": 0.0, "mid": 0.5, "high": 1.0})
    got = {r["k"]: (r["low"], r["mid"], r["high"]) for r in out.collect()}
    assert got == {"a": (1.0, 2.0, float("inf")), "b": (float("-inf"), 4.0, 4.0)}


def test_stats_beside_quantiles(table):
    from pyspark.sql import functions as F

    out = quantiles.stats_with_quantiles(table, ["k"], "v", {"m": 0.5}, [F.count("*").alias("n"), F.max("v").alias("x")])
    got = {r["k"]: (r["n"], r["x"], r["m"]) for r in out.collect()}
    assert got["empty"] == (1, None, None) and got["tiny"] == (1, 3.0, 3.0) and got["hot"][0] == 4001
    one = quantiles.stats_with_quantiles(table, [], "v", {"m": 0.5, "x": 1.0}, [F.count("v").alias("n")]).first()
    values = np.concatenate(list(groups().values()))
    assert one["n"] == len(values) and one["m"] == pytest.approx(np.percentile(values, 50)) and one["x"] == values.max()


def test_samples_have_the_exact_size(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k").repartition(7)
    for n in (0, 1, 777, 20_000, 30_000):
        assert hash_sample(df, ["k"], n=n).count() == min(n, 20_000)
    assert hash_sample(df, ["k"], fraction=0.123).count() == 2460
    want = {r["k"] for r in df.orderBy(sample_hash(["k"])).limit(500).collect()}
    assert {r["k"] for r in hash_sample(df.coalesce(1), ["k"], n=500).collect()} == want
