from __future__ import annotations

import math
import random

import numpy as np
import pytest
from cadastra.llm.hard_negatives import exact_scores, hard_negatives, pack_fields
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    *[T.StructField(n, T.StringType()) for n in ("id", "v", "row", "size", "block", "part", "n", "score")],
])


@pytest.mark.parametrize("top, d", [(0, 3), (1, 5), (150, 64), (4000, 64), (10**6, 8), (10**9, 4), (2**40, 3), (2.0**70, 2)])
def test_packed_products_are_exact(top, d):
    draw = random.Random(d)
    a, c = ([[math.floor(draw.uniform(-top, top)) for _ in range(d)] for _ in range(n)] for n in (7, 23))
    got = exact_scores(np.array(a, float), np.array(c, float))
    for i, x in enumerate(a):
        for j, y in enumerate(c):
            exact = sum(int(float(p)) * int(float(q)) for p, q in zip(x, y))
            assert got[i, j] == max(-(2**63) + 1, min(2**63 - 1, exact))


def test_fields_hold_several_rows():
    rows = np.arange(15, dtype=float).reshape(5, 3)
    packed = pack_fields(rows, 2, 10)
    assert packed.shape == (3, 3)
    assert packed[1].tolist() == [6 + 9 * 1024, 7 + 10 * 1024, 8 + 11 * 1024]


def brute(rows, step=50):
    """Anchors, positives and negatives by plain loops."""
    good = [(k, i, label, [math.floor(256 * x) for x in v]) for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, i, label, v in good:
        if i % step:
            continue
        scored = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j, m, other) for m, j, other, w in good if m != k and len(w) == len(v))
        for score, positive, _, _ in [s for s in scored if s[3] == label][:5]:
            fits = [s for s in scored if s[3] != label and 50 * -score <= 100 * -s[0] <= 95 * -score][:3]
            out += [(i, positive, rank, s[1], -score, -s[0]) for rank, s in enumerate(fits, 1)]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, *["x"] * 8) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hard_negatives(df, **options).collect())


def vectors(seed, n, d, kinds):
    draw = random.Random(seed)
    return [(i, [draw.choice(kinds) if kinds else draw.randrange(-512, 1024) / 1024 for _ in range(d)], draw.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("kinds", [None, [0.0, 0.25, 0.5]])
def test_against_plain_loops(spark, kinds):
    rows = vectors(3, 260, 6, kinds)  # few kinds of components: many ties
    assert brute(rows, 10)
    for options in ({}, {"block_rows": 40, "block_anchors": 7}):
        assert found(spark, rows, anchor_step=10, **options) == brute(rows, 10)


def test_odd_rows(spark):
    rows = vectors(4, 60, 4, None)
    rows += [(None, [1.0] * 4, 1), (100, None, 1), (101, [1.0] * 4, None), (102, [1.0, None, 1.0, 1.0], 0), (103, [float("nan")] * 4, 0), (104, [float("inf")] * 4, 1)]
    rows += [(200, [], 0), (201, [], 1), (210, [0.0] * 4, 2), (220, [1e30] * 4, 0), (221, [1e30, -1e30, 0.5, 0.25], 1), (230, [0.5, 0.5], 1), (231, [0.5, 0.25], 1), (232, [0.4, 0.25], 0)]
    rows = [(i, [None if x is None else float(np.float32(x)) for x in v] if v else v, label) for i, v, label in rows]
    got = found(spark, rows, anchor_step=10, block_rows=16)
    assert got == brute(rows, 10)
    assert any(r[0] == 230 for r in got)
    assert found(spark, []) == []


def test_repeated_rows_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (7, [0.8, 0.1], 2), (7, [0.8, 0.1], 2), (8, [0.7, 0.1], 2), (9, [0.1, 0.1], 2)]
    got = found(spark, rows)
    assert len(got) == 2 * 2 * 3 and {r[1] for r in got} == {0, 5} and [r[3] for r in got if r[1] == 5][:6].count(7) == 4
