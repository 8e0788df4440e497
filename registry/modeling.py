"""Encoders, imputation, error reports, samples, charts, training and importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.functions import errors
from cadastra.operators import encoding, quantiles, sampling
from cadastra.plans import evaluate, importance, train
from cadastra.session import stage
from registry import standins as st
from registry.cleaning import FACT, FEATURES
from registry.core import query, rounded, table, with_sql
from registry.series import model_table_parts

# Predictions for the error reports: the train mean of the postal area on the log scale.
SCORED_PARTS = [
    *st.FEATURE_PARTS,
    ("te", "select POSTAL_FSA as k, avg(ln(1 + CURRENT_LAND_VALUE)) as v from features where REPORT_YEAR < 2024 group by 1"),
    ("g", "select avg(ln(1 + CURRENT_LAND_VALUE)) as v from features where REPORT_YEAR < 2024"),
    (
        "scored",
        """select PID, LEGAL_TYPE, nullif(NEIGHBOURHOOD_CODE, '7') as NEIGHBOURHOOD_CODE, CURRENT_LAND_VALUE as y_true,
 greatest(exp(coalesce(te.v, (select v from g))) - 1, 0.0) as y_pred from features left join te on POSTAL_FSA = te.k where REPORT_YEAR >= 2024""",
    ),
]
SCORED = with_sql(*SCORED_PARTS)


def split(spark, sf):
    feats = stage(st.features(spark, sf))
    return feats.where(F.col("REPORT_YEAR") < 2024), feats.where(F.col("REPORT_YEAR") >= 2024)


def scored(spark, sf):
    before, after = split(spark, sf)
    encoder = encoding.fit_target_encoder(before, ["POSTAL_FSA"], errors.log_target("CURRENT_LAND_VALUE"))
    out = encoding.target_encoded(encoder, after)
    out = out.select(
        "PID",
        "LEGAL_TYPE",
        F.expr("nullif(NEIGHBOURHOOD_CODE, '7')").alias("NEIGHBOURHOOD_CODE"),
        F.col("CURRENT_LAND_VALUE").alias("y_true"),
        errors.unlog_prediction("POSTAL_FSA_te").alias("y_pred"),
    )
    return stage(out)


@query(
    FEATURES
    + """, g as (select avg(ln(1 + CURRENT_LAND_VALUE)) as v from features where REPORT_YEAR < 2024),
 a as (select PROPERTY_POSTAL_CODE as k, avg(ln(1 + CURRENT_LAND_VALUE)) as v from features where REPORT_YEAR < 2024 group by 1),
 b as (select NEIGHBOURHOOD_CODE as k, avg(ln(1 + CURRENT_LAND_VALUE)) as v from features where REPORT_YEAR < 2024 group by 1)
select PID, round(coalesce(a.v, (select v from g)), 6) as PROPERTY_POSTAL_CODE_te, round(coalesce(b.v, (select v from g)), 6) as NEIGHBOURHOOD_CODE_te
from features left join a on PROPERTY_POSTAL_CODE = a.k left join b on NEIGHBOURHOOD_CODE = b.k where REPORT_YEAR >= 2024"""
)
def target_encoding(spark, sf):
    before, after = split(spark, sf)
    cols = ["PROPERTY_POSTAL_CODE", "NEIGHBOURHOOD_CODE", "NOT_THERE"]
    encoder = encoding.fit_target_encoder(before, cols, errors.log_target("CURRENT_LAND_VALUE"))
    both = train.encode_targets(after, encoder, "b")
    return rounded(both.select("PID", "PROPERTY_POSTAL_CODE_te", "NEIGHBOURHOOD_CODE_te"), 6)


@query(
    FEATURES
    + """, k as (select LOT, row_number() over (order by LOT) - 1 as i from (select distinct LOT from features where REPORT_YEAR < 2024 and LOT < '25')),
 p as (select PLAN, row_number() over (order by PLAN) - 1 as i from (select distinct PLAN from features where REPORT_YEAR < 2024 and LOT < '25'))
select PID, cast(coalesce(k.i, -1) as double) as LOT_idx, cast(coalesce(p.i, -1) as double) as PLAN_idx
from features f left join k on f.LOT = k.LOT left join p on f.PLAN = p.PLAN where REPORT_YEAR >= 2024"""
)
def ordinal_encoding(spark, sf):
    """Categories in text order; those not seen in training give -1."""
    before, after = split(spark, sf)
    encoder = encoding.fit_ordinal_encoder(before.where(F.col("LOT") < "25"), ["LOT", "PLAN"])
    return encoding.ordinal_encoded(encoder, after).select("PID", "LOT_idx", "PLAN_idx")


@query(
    FACT
    + """select 'YEAR_BUILT' as feature, median(YEAR_BUILT) as median from fact union all select 'BIG_IMPROVEMENT_YEAR', median(BIG_IMPROVEMENT_YEAR) from fact
 union all select 'CURRENT_LAND_VALUE', median(CURRENT_LAND_VALUE) from fact"""
)
def column_medians(spark, sf):
    return encoding.column_medians(st.fact(spark, sf), ["YEAR_BUILT", "BIG_IMPROVEMENT_YEAR", "CURRENT_LAND_VALUE"])


@query(
    FACT
    + """select feature, mode from (select *, row_number() over (partition by feature order by n desc, mode) as r from (
 select 'PLAN' as feature, PLAN as mode, count(*) as n from fact group by PLAN union all
 select 'LEGAL_TYPE', LEGAL_TYPE, count(*) from fact group by LEGAL_TYPE)) where r = 1"""
)
def column_modes(spark, sf):
    return encoding.column_modes(st.fact(spark, sf), ["PLAN", "LEGAL_TYPE"])


@query(
    "select l_returnflag, count(l_extendedprice) as n, round(quantile_cont(l_extendedprice, 0.5), 4) as p50, "
    "round(quantile_cont(l_extendedprice, 0.9), 4) as p90, round(quantile_cont(l_extendedprice, 0.995), 4) as p995 from lineitem group by 1"
)
def exact_quantiles_of_large_groups(spark, sf):
    """The way without large groups in memory, whatever their size."""
    probs = {"p50": 0.5, "p90": 0.9, "p995": 0.995}
    line = table(spark, sf, "lineitem")
    return rounded(quantiles.exact_quantiles(line, ["l_returnflag"], "l_extendedprice", probs, count="n"))


@query(
    "with v as (select l_returnflag, power(10, -(l_orderkey % 250)) * l_extendedprice as v from lineitem) "
    "select l_returnflag, count(v) as n, round(log10(quantile_cont(v, 0.1)), 6) as p10, round(log10(quantile_cont(v, 0.5)), 6) as p50, "
    "round(log10(quantile_cont(v, 0.9)), 6) as p90 from v group by 1"
)
def quantiles_near_zero(spark, sf):
    """Values over 250 decades, told as logarithms."""
    small = table(spark, sf, "lineitem").withColumn("v", F.pow(F.lit(10.0), -(F.col("l_orderkey") % 250)) * F.col("l_extendedprice"))
    out = quantiles.exact_quantiles(small, ["l_returnflag"], "v", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, count="n")
    return out.select("l_returnflag", "n", *[F.round(F.log10(c), 6).alias(c) for c in ("p10", "p50", "p90")])


@query(
    SCORED + "select PID, round(abs(y_pred - y_true), 4) as abs_error, round(abs(y_pred - y_true) / y_true, 6) as ape, "
    "round(least(y_true, 400000), 4) as capped from scored"
)
def error_columns(spark, sf):
    out = evaluate.with_errors(scored(spark, sf))
    return out.select(
        "PID",
        F.round("abs_error", 4).alias("abs_error"),
        F.round("ape", 6).alias("ape"),
        F.round(errors.capped("y_true", 400000), 4).alias("capped"),
    )


@query(
    SCORED
    + """, c as (select quantile_cont(CURRENT_LAND_VALUE, 0.995) as cap from features where REPORT_YEAR < 2024)
select round(sqrt(avg((y_pred - y_true) ** 2)), 4) as rmse, round(avg(abs(y_pred - y_true)), 4) as mae, round(median(abs(y_pred - y_true) / y_true), 4) as median_ape,
 round(cap, 4) as robust_cap_p99_5, round(sqrt(avg((least(y_pred, cap) - least(y_true, cap)) ** 2)), 4) as robust_rmse,
 round(avg(abs(least(y_pred, cap) - least(y_true, cap))), 4) as robust_mae from scored, c group by cap"""
)
def regression_metrics(spark, sf):
    before, _ = split(spark, sf)
    cap = evaluate.target_cap(before, "CURRENT_LAND_VALUE")
    return rounded(evaluate.regression_metrics(scored(spark, sf), cap))


GROUP_ERRORS = """select NEIGHBOURHOOD_CODE, count(*) as count, round(avg(abs(y_pred - y_true)), 4) as mean_abs_error,
 round(sqrt(avg((y_pred - y_true) ** 2)), 4) as rmse, round(median(abs(y_pred - y_true) / y_true), 4) as median_ape from scored group by 1"""


@query(SCORED + GROUP_ERRORS)
def errors_by_neighbourhood(spark, sf):
    return rounded(evaluate.group_errors(scored(spark, sf), "NEIGHBOURHOOD_CODE"))


@query(
    SCORED
    + """select LEGAL_TYPE, count(*) as count, round(avg(abs(y_pred - y_true)), 4) as mean_abs_error, round(median(abs(y_pred - y_true)), 4) as median_abs_error,
 round(sqrt(avg((y_pred - y_true) ** 2)), 4) as rmse, round(median(abs(y_pred - y_true) / y_true), 4) as median_ape,
 round(quantile_cont(abs(y_pred - y_true) / y_true, 0.9), 4) as p90_ape from scored group by 1"""
)
def errors_by_legal_type(spark, sf):
    return rounded(evaluate.group_error_spread(scored(spark, sf), "LEGAL_TYPE"))


SANITY = """select 'y_true' as side, round(quantile_cont(y_true, 0.5), 4) as p50, round(quantile_cont(y_true, 0.9), 4) as p90,
 round(quantile_cont(y_true, 0.99), 4) as p99, round(max(y_true), 4) as max from scored
union all select 'y_pred', round(quantile_cont(y_pred, 0.5), 4), round(quantile_cont(y_pred, 0.9), 4), round(quantile_cont(y_pred, 0.99), 4), round(max(y_pred), 4) from scored"""


@query(SCORED + SANITY)
def prediction_sanity(spark, sf):
    return rounded(evaluate.sanity_stats(scored(spark, sf)))


@query(
    SCORED
    + """select round(quantile_cont(y_true, 0.99), 4) as p99_true, round(quantile_cont(y_pred, 0.99) / 20, 4) as p99_pred,
 case when quantile_cont(y_pred, 0.99) / 20 / quantile_cont(y_true, 0.99) < 0.1 then 'prediction scale seems off: p99 ratio is '
  || printf('%.3f', quantile_cont(y_pred, 0.99) / 20 / quantile_cont(y_true, 0.99)) else '' end as warning from scored"""
)
def prediction_scale_warning(spark, sf):
    small = scored(spark, sf).withColumn("y_pred", F.col("y_pred") / 20)
    return rounded(evaluate.scale_warning(evaluate.sanity_stats(small)))


@query("select o_orderkey, o_totalprice from orders order by md5(o_orderkey || ':42') limit 1000")
def fixed_size_sample(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return sampling.hash_sample(orders, ["o_orderkey"], n=1000)


@query(
    "select o_orderkey, o_custkey from (select *, row_number() over (order by md5(o_orderkey || ':7')) as r, count(*) over () as n from orders) where r <= round(n * 0.15)"
)
def fraction_sample(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return sampling.hash_sample(orders, ["o_orderkey"], fraction=0.15, seed=7)


@query(SCORED + "select PID, round(y_true, 4) as y_true, round(y_pred, 4) as y_pred from scored order by md5(PID || ':42') limit 500")
def chart_scatter_points(spark, sf):
    return rounded(evaluate.scatter_points(scored(spark, sf).select("PID", "y_true", "y_pred"), ["PID"], 500))


@query(
    SCORED + ", v as (select y_true as v from scored union all select y_pred from scored) "
    "select round(quantile_cont(v, 0.01), 4) as low, round(quantile_cont(v, 0.99), 4) as high from v"
)
def chart_guide_line(spark, sf):
    return rounded(evaluate.guide_line(scored(spark, sf)))


@query(
    SCORED
    + """, e as (select quantile_cont(y_pred - y_true, 0.01) as lo, quantile_cont(y_pred - y_true, 0.99) as hi from scored),
 b as (select cast(least(floor((least(greatest(y_pred - y_true, lo), hi) - lo) / ((hi - lo) / 60)), 59) as integer) as bin, count(*) as rows from scored, e group by 1)
select bin, round(lo + bin * ((hi - lo) / 60), 4) as from_value, round(lo + (bin + 1) * ((hi - lo) / 60), 4) as to_value, rows from b, e"""
)
def chart_residual_histogram(spark, sf):
    return rounded(evaluate.residual_histogram(scored(spark, sf)))


@query(SCORED + f", e as ({GROUP_ERRORS}) select * from e order by mean_abs_error desc, NEIGHBOURHOOD_CODE limit 20")
def chart_hardest_groups(spark, sf):
    return evaluate.hardest_groups(rounded(evaluate.group_errors(scored(spark, sf), "NEIGHBOURHOOD_CODE")), "NEIGHBOURHOOD_CODE")


@query(
    """with b as (select p_brand, round(sum(p_retailprice), 4) as importance_abs from part group by 1),
 r as (select *, row_number() over (order by importance_abs desc, p_brand) as importance_rank, count(*) over () as n from b)
select p_brand, importance_abs, cast(importance_rank as integer) as importance_rank, 'most_important' as importance_bucket from r where importance_rank <= 10
union all select p_brand, importance_abs, cast(importance_rank as integer), 'least_important' from r where importance_rank > n - 10"""
)
def top_and_bottom_ranks(spark, sf):
    brands = table(spark, sf, "part").groupBy("p_brand").agg(F.round(F.sum("p_retailprice"), 4).alias("importance_abs"))
    return evaluate.top_and_bottom(evaluate.ranked_by(brands, "importance_abs", "p_brand", "importance_rank"), "importance_rank")


@query(
    """select p_partkey, name as base_feature, case when name like 'neigh\\_prev\\_year\\_%' escape '\\' or name like 'fsa\\_prev\\_year\\_%' escape '\\' then 'local_history'
 when regexp_matches(name, '^(mortgage_|ircc_|study_permits_|cmhc_|census_)') or regexp_matches(name, '(_lag1|_yoy_change)$') then 'macro_temporal'
 when name in ('LEGAL_TYPE', 'YEAR_BUILT') then 'property_location_structure' else 'other' end as feature_group,
 case when name like 'mortgage%' then 'mortgage rate series' when name like 'fsa%' then 'earlier years of the assessment extract'
  when name in ('LEGAL_TYPE', 'YEAR_BUILT') then 'assessment extract' else 'derived while building the table' end as source_dataset,
 case when name like 'mortgage%' then 'Mortgage rate of the year' when name like 'fsa%' then 'Mean value of the postal area a year before'
  else upper(substr(name, 1, 1)) || substr(lower(replace(name, '_', ' ')), 2) end as plain_language_meaning
from (select p_partkey, case p_size % 6 when 0 then 'LEGAL_TYPE' when 1 then 'fsa_prev_year_mean_land_value' when 2 then 'mortgage_' || p_type
 when 3 then p_brand || '_lag1' when 4 then 'YEAR_BUILT' else p_name || '__x' end as name from part)"""
)
def feature_labels(spark, sf):
    """Group and meaning of feature names made from the parts."""
    name = F.expr(
        "case p_size % 6 when 0 then 'LEGAL_TYPE' when 1 then 'fsa_prev_year_mean_land_value' when 2 then concat('mortgage_', p_type) "
        "when 3 then concat(p_brand, '_lag1') when 4 then 'YEAR_BUILT' else concat(p_name, '__x') end"
    )
    parts = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("num__"), name).alias("feature"))
    named = parts.withColumn("base_feature", importance.base_feature("feature"))
    out = importance.with_meaning(named.withColumn("feature_group", importance.feature_group("base_feature")), "base_feature")
    return out.select("p_partkey", "base_feature", "feature_group", "source_dataset", "plain_language_meaning")


def trained_model(spark, sf):
    """(bundle, scored test rows, train rows, model table): default settings on the written model table, as the training job does."""
    model = stage(model_table_parts(spark, sf)[0])
    return *train.train_and_score(model), model


@query(
    with_sql(*st.FEATURE_PARTS)
    + """, rows as (select REPORT_YEAR < 2024 as before, CURRENT_LAND_VALUE as v from features where CURRENT_LAND_VALUE > 0)
select 'model_spark_gbt' as model, 'spark_gbt' as model_backend, 'b' as encoding_mode, 'log1p' as target_encoding_target,
 count(*) filter (before) as n_train, count(*) filter (not before) as n_test, round(quantile_cont(v, 0.995) filter (before), 4) as robust_cap_p99_5,
 true as fits_better_than_mean from rows"""
)
def train_and_evaluate(spark, sf):
    """The result row: what SQL can count as it is, and whether the trees fit the training rows better than their mean does."""
    bundle, out, before, _ = trained_model(spark, sf)
    row = train.result_row(bundle, train.judged(out), before)
    label = errors.log_target("CURRENT_LAND_VALUE")
    known = train.predict(encoding.target_encoded(bundle.target_encoder, before), bundle)
    fitted = known.agg(F.avg(errors.sq_error(label, errors.log_target("y_pred"))).alias("model"), F.var_pop(label).alias("mean")).first()
    return row.select(
        "model", "model_backend", "encoding_mode", "target_encoding_target", F.col("n_train").cast("long").alias("n_train"), F.col("n_test").cast("long").alias("n_test"),
        F.round("robust_cap_p99_5", 4).alias("robust_cap_p99_5"),
        (F.lit(fitted["model"]) < F.lit(fitted["mean"])).alias("fits_better_than_mean"),
    )


@query()
def trained_metrics(spark, sf):
    """The whole result row of the trained model; SQL has no trees."""
    bundle, out, before, _ = trained_model(spark, sf)
    return train.result_row(bundle, train.judged(out), before)


@query()
def native_feature_importance(spark, sf):
    bundle, _, _, _ = trained_model(spark, sf)
    return importance.explained_importance(importance.importance_table(importance.native_importance(bundle)))


@query()
def permutation_feature_importance(spark, sf):
    """Every feature over all test rows, with what its group adds up to."""
    bundle, out, _, _ = trained_model(spark, sf)
    shuffled = importance.permutation_importance(bundle, out.drop("y_true", "y_pred"), ["PID"])
    whole = stage(importance.importance_table(shuffled))
    return whole.join(importance.grouped_importance(whole), "feature_group")
