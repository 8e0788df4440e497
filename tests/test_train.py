"""Training, persistence, importance and scoring on a small table."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cadastra.plans import evaluate, importance, scoring, train

SCHEMA = (
    "PID string, REPORT_YEAR int, NEIGHBOURHOOD_CODE string, CURRENT_LAND_VALUE double, LEGAL_TYPE string, PROPERTY_POSTAL_CODE string, "
    "POSTAL_FSA string, PLAN string, YEAR_BUILT double, neigh_level double"
)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(8)
    rows = []
    for i in range(600):
        n = i % 6
        rows.append(
            (str(i), 2020 + i % 7, str(n), 1e5 * (n + 1) * rng.uniform(0.9, 1.1), "LAND" if i % 2 else "STRATA",
             f"V{n}H{i % 3}J4", f"V{n}H", f"P{i % 9}", None if i % 10 == 0 else 1900.0 + i % 100, float(n) if i % 4 else None)
        )
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def fitted(table):
    return train.train_and_score(table, train.TrainSettings(trees=8, depth=3, step=0.3))


def test_metrics_and_columns(fitted):
    bundle, scored, before = fitted
    row = train.result_row(bundle, scored, before).first()
    assert row["n_train"] + row["n_test"] == 600 and row["median_ape"] < 0.12
    assert "PROPERTY_POSTAL_CODE" not in bundle.feature_cols and "PROPERTY_POSTAL_CODE_te" in bundle.numeric_cols
    assert set(bundle.cat_cols) == {"POSTAL_FSA", "PLAN"}


def test_same_seed_same_model(table, fitted):
    again = train.train_and_score(table, fitted[0].settings)[1]
    first = {r["PID"]: r["y_pred"] for r in fitted[1].select("PID", "y_pred").collect()}
    assert first == pytest.approx({r["PID"]: r["y_pred"] for r in again.select("PID", "y_pred").collect()})


def test_modes(table):
    both = train.TrainSettings(trees=1, encoding_mode="a", sample_fraction=0.5)
    bundle, scored, before = train.train_and_score(table, both)
    assert "LEGAL_TYPE" in bundle.cat_cols and "LEGAL_TYPE_te" in bundle.numeric_cols
    assert before.count() == round(0.5 * table.where("REPORT_YEAR < 2024").count())
    with pytest.raises(ValueError, match="encoding_mode"):
        train.train_and_score(table, train.TrainSettings(encoding_mode="c"))


def test_importance(fitted):
    bundle, scored, _ = fitted
    by_shuffle = importance.permutation_importance(bundle, scored, ["PID"], max_rows=200, repeats=2)
    table = importance.importance_table(by_shuffle)
    rows = table.orderBy("importance_rank").collect()
    assert len(rows) == len(bundle.feature_cols) and sum(r["importance_share"] for r in rows) == pytest.approx(1.0)
    strong = {"num__neigh_level", "num__NEIGHBOURHOOD_CODE_te", "num__PROPERTY_POSTAL_CODE_te", "cat__POSTAL_FSA"}
    assert rows[0]["feature"] in strong
    assert sum(r["group_importance_share"] for r in importance.grouped_importance(table).collect()) == pytest.approx(1.0)
    assert importance.importance_extremes(table, 2).count() == 4
    native = importance.importance_table(importance.native_importance(bundle))
    assert importance.explained_importance(native).count() == len(rows)
    assert importance.top_importances(native, 3).count() == 3


def test_importance_of_all_rows(spark, fitted, monkeypatch):
    from registry import modeling

    asked = []
    real = importance.permutation_importance
    monkeypatch.setattr(modeling, "trained_model", lambda spark, sf: (*fitted, None))
    monkeypatch.setattr(modeling.importance, "permutation_importance", lambda *a, **b: asked.append((len(a), b)) or real(*a, **b))
    got = {r["feature"]: r for r in modeling.permutation_feature_importance(spark, "").collect()}
    bundle = fitted[0]
    assert asked == [(3, {})] and set(got) == set(bundle.input_cols)
    unused = {r["feature"] for r in importance.native_importance(bundle).collect() if r["importance"] == 0}
    assert unused and all(got[f]["importance"] == pytest.approx(0, abs=1e-12) for f in unused)
    for group in {r["feature_group"] for r in got.values()}:
        own = [r for r in got.values() if r["feature_group"] == group]
        assert own[0]["group_importance"] == pytest.approx(sum(r["importance_abs"] for r in own))


def test_saved_model_scores_requests(spark, table, fitted, tmp_path):
    bundle, scored, before = fitted
    train.save_bundle(bundle, str(tmp_path / "m"))
    loaded = train.load_bundle(spark, str(tmp_path / "m"))
    asked = spark.createDataFrame(
        [(1, "v3h 0j4", "LAND", "RS", "RS-1", "3", "1990", None, None, None), (2, "V3H0J4", "", "RS", "RS-1", "3", "1990", None, "2030", "p1"),
         (3, "V9Z9Z9", "LAND", "RS", "RS-1", "77", "1990", "2000", "2031", "p1"), (4, "bad", "LAND", "RS", "RS-1", "3", "1990", None, None, None)],
        "request_id int, PROPERTY_POSTAL_CODE string, LEGAL_TYPE string, ZONING_DISTRICT string, ZONING_CLASSIFICATION string, NEIGHBOURHOOD_CODE string, "
        "YEAR_BUILT string, BIG_IMPROVEMENT_YEAR string, REPORT_YEAR string, PLAN string",
    )
    errors = evaluate.group_errors(scored, "NEIGHBOURHOOD_CODE")
    metrics = train.result_row(bundle, scored, before)
    results = [
        {r["request_id"]: r for r in scoring.score_requests(asked, b, table, errors, metrics).collect()} for b in (bundle, loaded)
    ]
    got = results[0]
    assert set(got) == {1, 3}
    assert got[1]["point_estimate"] == pytest.approx(4e5, rel=0.3)
    assert got[1]["error_band_source"] == "neighbourhood_mean_abs_error" and got[3]["error_band_source"] == "global_robust_mae"
    assert got[1]["used_features"]["REPORT_YEAR"] == 2026 and got[3]["used_features"]["LOOKUP_YEAR_FALLBACK"]
    assert got[1]["used_features"]["LOOKUP_SUPPORTED_YEAR_RANGE"] == "2020-2026"
    for k, r in got.items():
        assert r["upper_bound"] - r["point_estimate"] == pytest.approx(r["error_band"]) and r["lower_bound"] >= 0
        assert results[1][k]["point_estimate"] == pytest.approx(r["point_estimate"])
    refused = {r["request_id"]: r["errors"] for r in scoring.refused_requests(asked, 2026).collect()}
    assert refused == {2: ["missing_LEGAL_TYPE"], 4: ["invalid_postal_code"]}


def test_hardest_groups_and_weighted_error(fitted):
    _, scored, _ = fitted
    by_group = evaluate.group_errors(scored, "NEIGHBOURHOOD_CODE")
    weighted = by_group.agg((F.sum(F.col("count") * F.col("mean_abs_error")) / F.sum("count")).alias("mae")).first()["mae"]
    assert weighted == pytest.approx(evaluate.regression_metrics(scored, 1e9).first()["mae"])
    assert evaluate.hardest_groups(by_group, "NEIGHBOURHOOD_CODE", 2).count() == 2
    assert evaluate.residual_histogram(scored).agg(F.sum("rows")).first()[0] == scored.count()


def test_registered_model_is_trained_on_the_whole_table(spark, monkeypatch):
    from registry import lookups, modeling
    from registry.series import model_table_parts

    sf = "/root/testdata/sf0.001"
    asked, looked = [], []
    monkeypatch.setattr(train, "train_and_score", lambda *a, **b: asked.append((a, b)) or (None, a[0], a[0]))
    *_, model = modeling.trained_model(spark, sf)
    assert asked == [((model,), {})] and model.columns == model_table_parts(spark, sf)[0].columns
    scored = model.withColumns({"y_true": F.col("CURRENT_LAND_VALUE"), "y_pred": F.col("CURRENT_LAND_VALUE")})
    monkeypatch.setattr(lookups, "trained_model", lambda spark, sf: (None, scored, model, model))
    monkeypatch.setattr(lookups.scoring, "score_requests", lambda *a: looked.append(a[2]))
    lookups.score_requests(spark, sf)
    assert looked == [model]


def test_training_is_dealt_to_all_tasks(spark, table, fitted, monkeypatch):
    """A table of one file has one task, and so had everything written from it."""
    written = []

    def kept(df, *a, **k):
        written.append(df)
        return staged_split(df, *a, **k)

    staged_split = train.staged_split
    monkeypatch.setattr(train, "staged_split", kept)
    monkeypatch.setattr(train, "fit_model", lambda *a: fitted[0])
    train.train_and_score(table.coalesce(1), fitted[0].settings)
    assert written[0].rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_table_of_many_files_is_not_dealt_again(spark, table, fitted, monkeypatch, tmp_path):
    """Dealing shuffles the whole table, which only a table of few files needs."""
    path = f"file:{tmp_path}/model"
    table.repartition(2 * spark.sparkContext.defaultParallelism).write.parquet(path)
    dealt_, real = [], train.dealt
    monkeypatch.setattr(train, "dealt", lambda df, *keys: dealt_.append(keys) or real(df, *keys))
    monkeypatch.setattr(train, "fit_model", lambda *a: fitted[0])
    many = train.train_and_score(spark.read.parquet(path), fitted[0].settings)
    assert not dealt_
    few = train.train_and_score(spark.read.parquet(path).coalesce(1).localCheckpoint(), fitted[0].settings)
    assert dealt_ == [("PID",)] and many[1].count() == few[1].count() and many[2].exceptAll(few[2]).isEmpty()


def test_judged_rows_are_narrow(fitted):
    bundle, scored, before = fitted
    own = train.judged(scored, "NEIGHBOURHOOD_CODE")
    assert own.columns == ["y_true", "y_pred", "NEIGHBOURHOOD_CODE"]
    first, second = (train.result_row(bundle, df, before).first().asDict() for df in (own, scored))
    assert all(second[k] == (pytest.approx(v) if isinstance(v, float) else v) for k, v in first.items())
