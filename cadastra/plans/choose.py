"""Choice of a back end by blocks of years inside the training years."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from cadastra.functions.errors import abs_error, log_target
from cadastra.operators.encoding import target_encoded
from cadastra.plans.train import BACKENDS, TrainSettings, fit_model, load_training_table, predict
from cadastra.session import stage

SCORES = "backend string, fold_year int, n_train long, n_valid long, error double, baseline_error double"


def fold_baselines(train: DataFrame, year: str, target: str, folds: int) -> DataFrame:
    """``fold_year, n_train, n_valid, mean, baseline_error`` of the last ``folds`` years that have years before them.

    The baseline predicts the mean log target of all years before the fold. Sums
    of the years, one row each, give the means; one more pass gives the errors.
    """
    label = log_target(target)
    years = train.groupBy(F.col(year).cast("int").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("total"))
    rows = years.orderBy("year").collect()  # one row a year
    means = []
    for i in range(max(1, len(rows) - folds), len(rows)):
        n = sum(r["n"] for r in rows[:i])
        means.append((rows[i]["year"], n, rows[i]["n"], sum(r["total"] for r in rows[:i]) / n))
    known = train.sparkSession.createDataFrame(means, "fold_year int, n_train long, n_valid long, mean double")
    errors = train.join(known, F.col(year).cast("int") == F.col("fold_year")).groupBy("fold_year", "n_train", "n_valid", "mean")
    return errors.agg(F.avg(F.abs(label - F.col("mean"))).alias("baseline_error"))


def compare_backends(df: DataFrame, settings: TrainSettings | None = None, backends: tuple[str, ...] = BACKENDS, folds: int = 3) -> DataFrame:
    """``SCORES``: mean absolute log error of each back end on each of the last training years, fitted on the years before.

    The test years are never read. One row per back end and fold comes back to
    the driver, the rows themselves stay where they are.
    """
    settings = settings or TrainSettings()
    table = load_training_table(df, settings)
    train = stage(table.where(F.col(settings.year) < settings.first_test_year))
    baselines = fold_baselines(train, settings.year, settings.target, folds).orderBy("fold_year").collect()
    scores = []
    for fold in baselines:
        before, valid = train.where(F.col(settings.year) < fold["fold_year"]), train.where(F.col(settings.year) == fold["fold_year"])
        for backend in backends:
            bundle = fit_model(before, replace(settings, backend=backend), fold["fold_year"])
            scored = predict(target_encoded(bundle.target_encoder, valid), bundle)
            error = scored.agg(F.avg(abs_error(log_target(settings.target), log_target("y_pred"))).alias("error")).first()["error"]
            scores.append((backend, fold["fold_year"], fold["n_train"], fold["n_valid"], error, fold["baseline_error"]))
    return df.sparkSession.createDataFrame(scores, SCORES)


def chosen_backend(scores: DataFrame) -> DataFrame:
    """One row: the back end whose error over all folds' rows is smallest (ties by name), with that error and the baseline's."""
    share = lambda c: (F.sum(F.col(c) * F.col("n_valid")) / F.sum("n_valid")).alias(c)
    return scores.groupBy("backend").agg(share("error"), share("baseline_error")).orderBy("error", "backend").limit(1)
