"""Stored history, permutations, sketches, guards, pruned reads, streams and the choice of a back end."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cadastra.operators import checks, history, history_store, pruning, requests, sketches
from cadastra.operators.shuffles import grid, permuted, with_permuted
from cadastra.plans import choose, importance, train
from cadastra.session import observed_stage, stage
from cadastra.sources.sinks import write_partitions, write_table
from cadastra.streaming.scoring import score_arrived


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 17, 1000, 4097])
def test_permutations_are_one_to_one(spark, n):
    a, b = grid(n)
    assert a * b >= n and a * b - n < max(a, 1)
    keys = [F.lit(k) for k in (0, 1, 2**40)]
    rows = spark.range(n).select("id", *[permuted("id", n, k).alias(f"p{i}") for i, k in enumerate(keys)]).collect()
    found = [[r[f"p{i}"] for r in rows] for i in range(3)]
    assert all(sorted(p) == list(range(n)) for p in found)
    if n > 100:
        assert found[0] != found[1] != found[2]
        for p in found:
            assert sum(x == i for i, x in enumerate(p)) < 10  # about one stays where it is
            assert sum(abs(p[i] - p[i + 1]) < n / 100 for i in range(n - 1)) < n / 10  # neighbours part


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1001])
def test_permutation_by_projections_is_the_same(spark, n):
    rows = spark.range(n).select("id", F.explode(F.sequence(F.lit(3), F.lit(9))).alias("k"))
    both = with_permuted(rows.withColumn("one", permuted("id", n, F.col("k"))), "other", "id", n, F.col("k"))
    assert both.columns == ["id", "k", "one", "other"] and both.where("one = other").count() == 7 * n


def test_permutation_of_many_rows(spark):
    n = 10**18 + 9
    rows = spark.createDataFrame([(0,), (1,), (n - 1,)], "id long").select(permuted("id", n, F.lit(5)).alias("p")).collect()
    assert len({r.p for r in rows}) == 3 and all(0 <= r.p < n for r in rows)
    with pytest.raises(ValueError):
        permuted("id", 0, F.lit(1))


def test_rise_of_a_known_model(spark):
    draw = random.Random(1)
    data = [(i, [draw.random(), draw.random(), 3.0], 0.0) for i in range(400)]
    rows = stage(spark.createDataFrame([(i, x, 2 * x[0] + x[2]) for i, x, _ in data], "row long, x array<double>, label double"))
    predict = lambda df: df.withColumn("prediction", 2 * F.col("x")[0] + F.col("x")[2])
    rise = {r.feature: r.rise for r in importance.shuffled_rise(rows, predict).collect()}
    assert rise[1] == rise[2] == 0.0  # unused, and the same in all rows
    assert abs(rise[0] - 2 / 3) < 0.05  # twice the mean distance of two draws
    assert importance.shuffled_rise(rows.where("row < 0"), predict).count() == 0


def test_permutations_meet_the_rows_a_few_at_a_time(spark, monkeypatch):
    """All cells at once are repeats times features times the table in shuffle files."""
    rows = stage(spark.range(200).select(F.col("id").alias("row"), F.array(*[F.rand(i) for i in range(5)]).alias("x"), F.rand(9).alias("label")))
    predict = lambda df: df.withColumn("prediction", F.col("x")[0] + 2 * F.col("x")[4])
    at_once = {r.feature: r.rise for r in importance.shuffled_rise(rows, predict, 3).collect()}
    met = []
    monkeypatch.setattr(importance, "stage", lambda df: met.append(df.count()) or stage(df))
    monkeypatch.setattr(importance, "AT_ONCE", 4)
    monkeypatch.setattr(importance, "CELLS", 0)
    in_steps = {r.feature: r.rise for r in importance.shuffled_rise(rows, predict, 3).collect()}
    assert met == [4, 4, 4, 3] and in_steps == pytest.approx(at_once) and at_once[0] != 0


def test_history_of_batches_is_the_history_of_all(spark, tmp_path):
    draw = random.Random(2)
    facts = [(draw.choice([2020, 2021, 2022, 2023]), draw.choice(["a", "b", None]), draw.choice([None, *map(float, range(20))])) for _ in range(300)]
    schema = "y int, g string, v double"
    path = f"{tmp_path}/state"
    batches = [[r for r in facts[:200] if r[0] < 2023], [r for r in facts if r[0] == 2023], [r for r in facts[200:] if r[0] < 2023]]
    written = [history_store.add_facts(spark, spark.createDataFrame(b, schema), path, "y", "g", "v") for b in batches]
    assert written == [[2020, 2021, 2022], [2023], [2020, 2021, 2022]]
    shown = lambda df: sorted(tuple(None if x is None else round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())
    want = history.group_history(spark.createDataFrame(facts, schema), "y", "g", "v", "p", True)
    got = history_store.stored_history(spark, path, "y", "g", "p", True).select(*want.columns)
    assert sorted(map(repr, shown(got))) == sorted(map(repr, shown(want)))
    before = {f.name for f in (tmp_path / "state" / "counts" / "year=2020").iterdir()}
    history_store.add_facts(spark, spark.createDataFrame([(2024, "a", 1.0)], schema), path, "y", "g", "v")
    assert {f.name for f in (tmp_path / "state" / "counts" / "year=2020").iterdir()} == before  # untouched


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    write = lambda rows: write_partitions(spark.createDataFrame(rows, "v int, y int"), f"{tmp_path}/t", ["y"])
    write([(1, 1), (2, 2)])
    write([(3, 2)])
    assert sorted((r.v, r.y) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [(1, 1), (3, 2)]


def test_merged_sketches_keep_their_bound(spark):
    draw = random.Random(3)
    rows = [(draw.randrange(40), draw.choice([draw.gauss(0, 1), 0.0])) for _ in range(20_000)] + [(99, None), (7, None)]
    df = stage(spark.createDataFrame(rows, "k int, v double").repartition(7))
    probs = {"p1": 0.01, "p50": 0.5, "p99": 0.99}
    finest = sketches.group_sketches(df, ["k"], "v")
    assert finest.where("k = 99").count() == 0
    merged = stage(sketches.sketch_quantiles(sketches.merged_sketches(finest, []), [], probs))
    errors = sketches.with_rank_errors(merged, df, [], "v", probs).first()
    assert errors["n"] == 20_000 and all(errors[f"{p}_error"] <= 2 * sketches.rank_error() for p in probs)


def test_guard_counts_while_writing(spark):
    left = spark.range(10).withColumnRenamed("id", "k")
    guard = checks.RowGuard()
    stage(guard.after(guard.before(left).join(spark.createDataFrame([(1, "a"), (1, "b")], "k long, s string"), "k", "left")))
    assert guard.counts() == (10, 11)
    with pytest.raises(ValueError, match="row count changed"):
        guard.check()
    table, seen = observed_stage(left, n=F.count(F.lit(1)), top=F.max("k"))
    assert seen == {"n": 10, "top": 9} and table.count() == 10
    with pytest.raises(ValueError, match="no train or no test"):
        checks.staged_split(left, "k", 100)


def test_only_asked_years_are_listed(spark, tmp_path):
    write_table(spark.range(700).selectExpr("id", "cast(2020 + id % 7 as int) as y"), f"{tmp_path}/facts", ["y"])
    asked = stage(spark.createDataFrame([(1, 2021), (2, 2024), (3, None), (4, 1999)], "r int, want int"))
    found = pruning.rows_of_asked_years(spark.read.parquet(f"{tmp_path}/facts"), "y", asked, F.col("want"))
    assert "dynamicpruning" in plan(found).lower()
    assert {r.y: r["count"] for r in found.groupBy("y").count().collect()} == {2021: 100, 2024: 100}


def test_prefixes_by_rank(spark):
    draw = random.Random(4)
    options = [("f" if i % 3 else "g", "".join(draw.choices("ab é", k=draw.randint(0, 6)))) for i in range(200)]
    options = sorted(set(options))
    asked = sorted({(o[0], o[1][: draw.randint(0, 6)]) for o in options} | {("f", ""), ("g", "zz"), ("h", "a")})
    ranked, spans = requests.prefix_ranges(spark.createDataFrame(options, "k string, text string"), spark.createDataFrame(asked, "k string, prefix string"), ["k"])
    assert "Generate" not in plan(ranked)
    at = {(r.k, r.text): r.rank for r in ranked.collect()}
    assert sorted(at.values()) == list(range(len(options)))
    got = {(r.k, r.prefix): {o for o, rank in at.items() if r.first <= rank < r.stop} for r in spans.collect()}
    assert got == {(k, p): {o for o in options if o[0] == k and o[1].startswith(p)} for k, p in asked}


def test_a_stream_answers_every_file_once(spark, tmp_path):
    path = lambda n: f"{tmp_path}/{n}"
    score = lambda df: df.withColumn("twice", F.col("v") * 2)
    run = lambda: score_arrived(spark, path("in"), "v long", score, path("out"), path("progress"), files_per_batch=2)
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).select(F.col("id").alias("v")).repartition(3).write.mode("append").parquet(path("in"))
        run()
        run()  # nothing new: nothing twice
        assert sorted(r.v for r in spark.read.parquet(path("out")).collect()) == list(range(part * 10 + 10))
    assert spark.read.parquet(path("out")).where("twice <> 2 * v").count() == 0


def test_choice_of_a_back_end(spark):
    draw = random.Random(5)
    rows = [(str(i), 2018 + i % 6, 0.0, float(draw.randrange(100))) for i in range(240)]
    rows = [(p, y, 1000.0 * 1.05 ** x, x) for p, y, _, x in rows]  # linear on the log scale
    df = spark.createDataFrame(rows, "PID string, REPORT_YEAR int, CURRENT_LAND_VALUE double, size double")
    settings = train.TrainSettings(high_cardinality=[], first_test_year=2022, trees=3, depth=2)
    scores = stage(choose.compare_backends(df, settings, folds=2))
    assert {(r.backend, r.fold_year) for r in scores.collect()} == {(b, y) for b in train.BACKENDS for y in (2020, 2021)}
    assert {(r.n_train, r.n_valid) for r in scores.collect()} == {(80, 40), (120, 40)}
    best = choose.chosen_backend(scores).first()
    assert best.backend == train.LINEAR and best.error < 0.01 < best.baseline_error
    with pytest.raises(ValueError, match="backend"):
        train.regressor(train.TrainSettings(backend="none"))
