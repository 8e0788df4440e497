"""A linear model that SQL can fit, through training, completion, scoring, streaming and storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.operators import encoding
from cadastra.plans import choose, evaluate, importance, scoring, train
from cadastra.session import stage
from cadastra.streaming.scoring import score_arrived
from registry import standins as st
from registry.cleaning import scratch
from registry.core import query, table, with_sql
from registry.lookups import _N, _POSTAL, _REQUIRED, _absent, scoring_requests, scoring_sql

SETTINGS = train.TrainSettings(high_cardinality=["NEIGHBOURHOOD_CODE"], backend=train.LINEAR)

LINEAR_PARTS = [
    *st.FEATURE_PARTS,
    ("te", "select NEIGHBOURHOOD_CODE as k, avg(ln(1 + CURRENT_LAND_VALUE)) as v from features where REPORT_YEAR < 2024 group by 1"),
    ("facts", "select avg(ln(1 + CURRENT_LAND_VALUE)) as g, median(YEAR_BUILT) as built, quantile_cont(CURRENT_LAND_VALUE, 0.995) as cap from features where REPORT_YEAR < 2024"),
    (
        "inputs",
        """select PID, REPORT_YEAR, NEIGHBOURHOOD_CODE, CURRENT_LAND_VALUE as y_true, coalesce(te.v, g) as x1, coalesce(YEAR_BUILT, built) as x2, ln(1 + CURRENT_LAND_VALUE) as y
 from features left join te on NEIGHBOURHOOD_CODE = te.k cross join facts""",
    ),
    (
        "moments",
        """select avg(x1) as m1, avg(x2) as m2, avg(y) as my, var_pop(x1) as s11, var_pop(x2) as s22, covar_pop(x1, x2) as s12, covar_pop(x1, y) as s1y, covar_pop(x2, y) as s2y
 from inputs where REPORT_YEAR < 2024""",
    ),
    ("fit", "select m1, m2, my, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) as b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) as b2 from moments"),
    ("scored", "select PID, NEIGHBOURHOOD_CODE, y_true, greatest(exp(my + b1 * (x1 - m1) + b2 * (x2 - m2)) - 1, 0) as y_pred from inputs cross join fit where REPORT_YEAR >= 2024"),
]
_METRICS = """select round(sqrt(avg((y_pred - y_true) ** 2))) as rmse, round(avg(abs(y_pred - y_true))) as mae, round(median(abs(y_pred - y_true) / y_true), 6) as median_ape,
 round(sqrt(avg((least(y_pred, cap) - least(y_true, cap)) ** 2))) as robust_rmse, round(avg(abs(least(y_pred, cap) - least(y_true, cap)))) as robust_mae, round(cap) as robust_cap_p99_5"""


def linear_table(spark, sf):
    return stage(st.features(spark, sf).select("PID", "REPORT_YEAR", "CURRENT_LAND_VALUE", "NEIGHBOURHOOD_CODE", "YEAR_BUILT"))


def linear_model(spark, sf):
    """(bundle, scored test rows, train rows, model table)."""
    model = linear_table(spark, sf)
    return *train.train_and_score(model, SETTINGS), model


@query(
    with_sql(*LINEAR_PARTS)
    + "select 'model_spark_linear' as model, m.*, (select count(*) from features where REPORT_YEAR < 2024)::int as n_train, (select count(*) from scored)::int as n_test, "
    "2::int as n_features_total, 0::int as n_features_cat, 2::int as n_features_num, 'spark_linear' as model_backend, 'b' as encoding_mode, 'log1p' as target_encoding_target "
    f"from ({_METRICS} from scored cross join facts group by cap) m"
)
def linear_result_row(spark, sf):
    """The whole result row of a trained model."""
    bundle, out, before, _ = linear_model(spark, sf)
    row = train.result_row(bundle, stage(out), before)
    whole = {c: F.round(c) for c in ("rmse", "mae", "robust_rmse", "robust_mae", "robust_cap_p99_5")}
    return row.withColumns({**whole, "median_ape": F.round("median_ape", 6)})


@query(with_sql(*LINEAR_PARTS) + "select 'num__NEIGHBOURHOOD_CODE_te' as feature, round(abs(b1), 8) as importance from fit union all select 'num__YEAR_BUILT', round(abs(b2), 8) from fit")
def linear_native_importance(spark, sf):
    """A linear model reports its coefficients."""
    bundle, _, _, _ = linear_model(spark, sf)
    return importance.native_importance(bundle).withColumn("importance", F.round("importance", 8))


@query(with_sql(*LINEAR_PARTS) + "select PID, round(y_pred) as y_pred from scored")
def stored_model_scores(spark, sf):
    """Predictions of a model that was written and read back, with its encoder and fill values."""
    model = linear_table(spark, sf)
    before, after, seen = model.where("REPORT_YEAR < 2024"), model.where("REPORT_YEAR >= 2024"), 2026
    path = scratch(spark, "model")
    train.save_bundle(train.fit_model(before, SETTINGS, seen), path)
    bundle = train.load_bundle(spark, path)
    scored = train.predict(encoding.target_encoded(bundle.target_encoder, after), bundle)
    return scored.select("PID", F.round("y_pred").alias("y_pred"))


SCORES_SQL = (
    with_sql(*LINEAR_PARTS, ("request", scoring_sql()))
    + f""", asked as (
 select request_id, case when REPORT_YEAR is null then 2026 else cast({_N['REPORT_YEAR']} as integer) end as y, trim(NEIGHBOURHOOD_CODE) as n, {_N['YEAR_BUILT']} as built
 from request where not ({" or ".join(f"({_absent(c)})" for c in _REQUIRED)}) and regexp_full_match({_POSTAL}, '[A-Z][0-9][A-Z][0-9][A-Z][0-9]')),
 by_year as (select REPORT_YEAR as y, median(YEAR_BUILT) as m from features group by 1), overall as (select median(YEAR_BUILT) as m from features),
 points as (select request_id, a.y, n, greatest(exp(my + b1 * (coalesce(te.v, g) - m1) + b2 * (coalesce(a.built, by_year.m, overall.m) - m2)) - 1, 0) as point
  from asked a left join te on n = te.k left join by_year on a.y = by_year.y cross join overall cross join facts cross join fit),
 e as (select NEIGHBOURHOOD_CODE as k, avg(abs(y_pred - y_true)) as mean_abs_error from scored group by 1),
 m as (select avg(abs(least(y_pred, cap) - least(y_true, cap))) as robust_mae from scored cross join facts),
 banded as (select *, coalesce(mean_abs_error, robust_mae) as band from points left join e on n = e.k cross join m)
select request_id, round(point) as point_estimate, round(greatest(0, point - band)) as lower_bound, round(point + band) as upper_bound, round(band) as error_band,
 case when mean_abs_error is null then 'global_robust_mae' else 'neighbourhood_mean_abs_error' end as error_band_source, y as used_year, n as used_neighbourhood,
 y < 2020 or y > 2026 as year_fallback from banded"""
)


def _shown(scores):
    whole = [F.round(c).alias(c) for c in ("point_estimate", "lower_bound", "upper_bound", "error_band")]
    used = F.col("used_features")
    return scores.select(
        "request_id", *whole, "error_band_source", used["REPORT_YEAR"].alias("used_year"), used["NEIGHBOURHOOD_CODE"].alias("used_neighbourhood"), used["LOOKUP_YEAR_FALLBACK"].alias("year_fallback")
    )


def _scorer(spark, sf):
    """A function that scores requests, in a batch or a stream, with everything it needs written down."""
    bundle, out, before, lookup = linear_model(spark, sf)
    out = stage(out)
    by_group = stage(evaluate.group_errors(out, "NEIGHBOURHOOD_CODE"))
    metrics = stage(evaluate.regression_metrics(out, evaluate.target_cap(before, "CURRENT_LAND_VALUE")))
    return lambda requests: scoring.score_requests(requests, bundle, lookup, by_group, metrics)


@query(SCORES_SQL)
def linear_scores(spark, sf):
    """Requests through completion, prediction and error band."""
    return _shown(_scorer(spark, sf)(scoring_requests(spark, sf)))


@query(SCORES_SQL)
def streamed_scores(spark, sf):
    """The same requests as files that arrive one after another, scored as a stream in two runs."""
    folder, out, checkpoint = (scratch(spark, n) for n in ("arrived", "scores", "progress"))
    requests = scoring_requests(spark, sf)
    score = _scorer(spark, sf)
    for part in (0, 1):
        requests.where(F.pmod("request_id", F.lit(2)) == part).repartition(3).write.mode("append").parquet(folder)
        score_arrived(spark, folder, requests.schema, score, out, checkpoint, files_per_batch=2)
    return _shown(spark.read.parquet(out))


@query(
    with_sql(*st.FEATURE_PARTS)
    + """, r as (select REPORT_YEAR as y, ln(1 + CURRENT_LAND_VALUE) as l from features where REPORT_YEAR < 2024),
 folds as (select y from (select distinct y from r) where y > (select min(y) from r) order by y desc limit 2),
 means as (select folds.y as fold_year, count(*) as n_train, avg(l) as mean from folds join r on r.y < folds.y group by 1)
select fold_year, n_train, count(*) as n_valid, round(avg(abs(l - mean)), 8) as baseline_error, 3::bigint as backends, true as chosen_is_smallest, true as chosen_beats_mean
from means join r on r.y = fold_year group by 1, 2"""
)
def backend_folds(spark, sf):
    """Three back ends on the last two training years; the choice is the one with the smallest error, and better than the mean."""
    rows = stage(st.features(spark, sf).select("PID", "REPORT_YEAR", "CURRENT_LAND_VALUE", "NEIGHBOURHOOD_CODE", "YEAR_BUILT", "LEGAL_TYPE"))
    small = train.TrainSettings(high_cardinality=["NEIGHBOURHOOD_CODE"], trees=5, depth=3)
    scores = stage(choose.compare_backends(rows, small, folds=2))
    chosen = choose.chosen_backend(scores).select(F.struct("*")).scalar()
    folds = scores.withColumn("chosen", chosen).withColumn("total", F.sum(F.col("error") * F.col("n_valid")).over(_by_backend()) / F.sum("n_valid").over(_by_backend()))
    return folds.groupBy("fold_year", "n_train", "n_valid", F.round("baseline_error", 8).alias("baseline_error")).agg(
        F.count_distinct("backend").alias("backends"),
        (F.min("total") >= F.any_value("chosen.error") - 1e-12).alias("chosen_is_smallest"),
        F.any_value(F.col("chosen.error") < F.col("chosen.baseline_error") * 1.02).alias("chosen_beats_mean"),
    )


def _by_backend():
    from pyspark.sql import Window

    return Window.partitionBy("backend")


# The arithmetic of the permutation's network, as SQL.
_P, _Q, _ROUNDS, _REPEATS = (1 << 31) - 1, (1 << 31) - 19, 6, 2
_HASH = f"(((({{x}} % {_P}) * 48271 + key) % {_P} * 69621 + key) % {_Q} * 16807) % {_P} % {{size}}"
PERMUTATION_SQL = f"""
with recursive rows_ as materialized (
  select row_number() over (order by o_orderkey) - 1 as row, o_totalprice / 100000 as label, (o_custkey % 100) / 20 as x0, month(o_orderdate) / 10 as x1, o_orderkey % 7 as x2 from orders),
 size_ as materialized (select count(*)::bigint as n, floor(sqrt(count(*) - 1))::bigint + 1 as a, ceil(count(*) / (floor(sqrt(count(*) - 1)) + 1))::bigint as b from rows_),
 pairs as (select f::bigint as feature, r::bigint as repeat, (42 * 1000003 + f * {_REPEATS} + r)::bigint % {_P} as s from range(3) fs(f), range(1, {_REPEATS + 1}) rs(r)),
 keys as materialized (select feature, repeat, i::bigint as round, (m * 69621) % {_Q} as key from (select *, (s * 48271 + 1000003 * (i + 1)) % {_P} as m from pairs, range({_ROUNDS}) is_(i))),
 walk as (
  select row, feature, repeat, 0::bigint as round, row // b as l, row % b as r, false as done from rows_ cross join pairs cross join size_
  union all
  select row, feature, repeat, case when round = {_ROUNDS} then 0 else round + 1 end,
   case when round = {_ROUNDS} then l when round % 2 = 0 then (l + {_HASH.format(x="r", size="a")}) % a else l end,
   case when round = {_ROUNDS} then r when round % 2 = 1 then (r + {_HASH.format(x="l", size="b")}) % b else r end,
   round = {_ROUNDS} and l * b + r < n
  from walk cross join size_ left join keys using (feature, repeat, round) where not done),
 given as (select feature, repeat, l * b + r as row, case feature when 0 then x0 when 1 then x1 else x2 end as value from walk cross join size_ join rows_ using (row) where done),
 mixed as (select feature, repeat, label, 0.7 * case when feature = 0 then value else x0 end - 1.3 * case when feature = 1 then value else x1 end as p from given join rows_ using (row))
select 'x' || feature as feature, round(abs(avg(mae) - (select avg(abs(0.7 * x0 - 1.3 * x1 - label)) from rows_)), 8) as importance
from (select feature, repeat, avg(abs(p - label)) as mae from mixed group by 1, 2) group by 1"""


@query(PERMUTATION_SQL)
def permutation_of_linear_model(spark, sf):
    """Importance of a known linear model's features, under the very permutations that SQL works out too."""
    from cadastra.operators.sampling import numbered

    x = [(F.col("o_custkey") % 100) / 20, F.month("o_orderdate") / 10, F.col("o_orderkey") % 7]
    orders = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 100000).alias("label"), F.array(*[c.cast("double") for c in x]).alias("x"))
    rows = stage(numbered(orders, ["o_orderkey"], "row"))
    predict = lambda df: df.withColumn("prediction", 0.7 * F.col("x")[0] - 1.3 * F.col("x")[1])
    rise = importance.shuffled_rise(rows.select("row", "x", "label"), predict, _REPEATS)
    return rise.select(F.concat(F.lit("x"), F.col("feature")).alias("feature"), F.round(F.abs("rise"), 8).alias("importance"))
