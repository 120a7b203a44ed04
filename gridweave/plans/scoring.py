"""Queries of predictive scores and error metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.operators import scoring as X
from gridweave.plans.registry import query

_ENS = """ens as (select trial, truth, count(*) as n, avg(abs(value - truth)) - sum((2 * i - n0 - 1) * value) / (count(*) * count(*)) as crps,
  count(*) filter (value < truth) as rank, avg(value) as mean, stddev_samp(value) as sd
  from (select *, row_number() over (partition by trial order by value) as i, count(*) over (partition by trial) as n0 from draws) group by trial, truth)"""


@query("ensemble_crps", f"-- doubles: truth crps mean sd\nwith {_ENS} select * from ens", "draws")
def ensemble_crps(v):
    return X.ensemble_scores(v.draws)


@query("rank_pit", f"-- doubles: pit\nwith {_ENS} select trial, rank, (rank + 0.5) / (n + 1) as pit, (rank + 0.5) / (n + 1) >= 0.05 and (rank + 0.5) / (n + 1) <= 0.95 as covered from ens", "draws")
def rank_pit(v):
    return X.rank_interval(X.ensemble_scores(v.draws), 0.9).select("trial", "rank", "pit", "covered")


@query(
    "calibration_summary",
    f"""-- doubles: coverage mean_crps rmse rms_sd
    with {_ENS}, e as (select avg(((rank + 0.5) / (n + 1) >= 0.05 and (rank + 0.5) / (n + 1) <= 0.95)::int::double) as coverage, avg(crps) as mean_crps,
      sqrt(avg((mean - truth) * (mean - truth))) as rmse, sqrt(avg(sd * sd)) as rms_sd from ens),
    h as (select least(floor((rank + 0.5) / (n + 1) * 5), 4)::int as bin, count(*) as count from ens group by 1)
    select b::int as bin, coalesce(count, 0) as count, coverage, mean_crps, rmse, rms_sd from range(5) t(b) left join h on h.bin = b, e""",
    "draws",
)
def calibration_summary(v):
    return X.calibration(X.ensemble_scores(v.draws), 5, 0.9)


_SCORES = """count(*) as n, sqrt(avg((truth - mean) * (truth - mean))) as rmse, avg(abs(truth - mean)) as mae, avg(mean - truth) as bias, sqrt(avg(std * std)) as rms_sd,
""" + " ".join(f"avg((abs(truth - mean) <= {q} * std)::int::double) as within_{n}," for n, q in X.CENTRAL.items()) + """
  sqrt(avg((truth - mean) / std * ((truth - mean) / std))) as z_rmse, avg((truth - mean) / std) as z_bias, stddev_pop((truth - mean) / std) as z_std,
  avg(0.5 * ln(2 * pi()) + ln(std) + (truth - mean) * (truth - mean) / (2 * std * std)) as nlpd"""
_NAMES = "rmse mae bias rms_sd within_50 within_68 within_80 within_90 within_95 z_rmse z_bias z_std nlpd"


@query("predictive_scores", f"-- doubles: {_NAMES}\nselect {_SCORES} from pred_truth", "pred_truth")
def predictive_scores(v):
    return X.predictive_scores(v.pred_truth)


@query("uncertainty_bins", f"""-- doubles: {_NAMES}
with e as (select list_distinct([quantile_cont(std, 0.2), quantile_cont(std, 0.4), quantile_cont(std, 0.6), quantile_cont(std, 0.8)]) as edges from pred_truth)
select len(list_filter(edges, lambda x: x < std))::int as bin, {_SCORES} from pred_truth, e group by 1""", "pred_truth")
def uncertainty_bins(v):
    return X.uncertainty_bins(v.pred_truth)


@query("distance_bins", f"-- doubles: {_NAMES}\nselect (id % 1000 >= 100)::int + (id % 1000 >= 300)::int + (id % 1000 >= 600)::int as bin, {_SCORES} from pred_truth group by 1", "pred_truth")
def distance_bins(v):
    return X.distance_bins(v.pred_truth.withColumn("distance", F.col("id") % 1000), [100.0, 300.0, 600.0])


@query(
    "block_scores",
    f"-- doubles: rmse mae bias within_90 nlpd\nselect count(*) as blocks, avg(rmse) as rmse, avg(mae) as mae, avg(bias) as bias, avg(within_90) as within_90, avg(nlpd) as nlpd from (select block, {_SCORES} from pred_truth group by block)",
    "pred_truth",
)
def block_scores(v):
    return X.block_scores(v.pred_truth)


_ERR = "avg(abs(p - r)) as mae, avg((p - r) * (p - r)) as mse, sqrt(avg((p - r) * (p - r))) as rmse, max(abs(p - r)) as max_abs, avg(p - r) as bias"
_FIELD = "f as (select a.sample_id, a.value as p, b.value as r from temperature a join temperature b on a.row = b.row and a.col = b.col and b.sample_id = 0 where a.sample_id > 0)"


def _compared(v):
    ref = v.temperature.where("sample_id = 0").select("row", "col", F.col("value").alias("reference"))
    return v.temperature.where("sample_id > 0").join(ref, ["row", "col"]).withColumnRenamed("value", "prediction")


@query("field_error_metrics", f"-- doubles: mae mse rmse max_abs bias\nwith {_FIELD} select sample_id, {_ERR} from f group by sample_id", "temperature")
def field_error_metrics(v):
    return X.error_metrics(_compared(v), ("sample_id",))


@query(
    "error_percentiles",
    f"""-- doubles: above_01 above_05 above_10 p50 p90 p95 p99 p999
    with {_FIELD}, e as (select abs(p - r) as e from f) select avg((e::float > 0.1::float)::int::double) as above_01, avg((e::float > 0.5::float)::int::double) as above_05, avg((e::float > 1.0::float)::int::double) as above_10,
      quantile_cont(e, 0.5) as p50, quantile_cont(e, 0.9) as p90, quantile_cont(e, 0.95) as p95, quantile_cont(e, 0.99) as p99, quantile_cont(e, 0.999) as p999 from e""",
    "temperature",
)
def error_percentiles(v):
    return X.error_percentiles(_compared(v))


@query(
    "difference_metrics",
    f"-- doubles: max_abs mean_abs rmse relative_l2\nwith {_FIELD} select max(abs(p - r)) as max_abs, avg(abs(p - r)) as mean_abs, sqrt(avg((p - r) * (p - r))) as rmse, sqrt(sum((p - r) * (p - r))) / sqrt(sum(r * r)) as relative_l2 from f",
    "temperature",
)
def difference_metrics(v):
    return X.difference_metrics(_compared(v))


@query(
    "log_residual_metrics",
    """-- doubles: rmse mae bias correlation within_005 within_010 within_030 median_ratio
    with f as (select stratum, log10_k as p, log10_k + (id % 11 - 5) / 47.0::double as r from good_points)
    select stratum, count(*) as n, sqrt(avg((p - r) * (p - r))) as rmse, avg(abs(p - r)) as mae, avg(p - r) as bias, corr(p, r) as correlation, avg((abs(p - r) <= 0.05)::int::double) as within_005,
      avg((abs(p - r) <= 0.1)::int::double) as within_010, avg((abs(p - r) <= 0.3)::int::double) as within_030, median(pow(10.0, p - r)) as median_ratio from f group by stratum""",
    "good_points",
)
def log_residual_metrics(v):
    x = v.good_points.select("stratum", F.col("log10_k").alias("prediction"), (F.col("log10_k") + (F.col("id") % 11 - 5) / F.lit(47.0)).alias("reference"))
    return X.log_residuals(x, ("stratum",))


@query(
    "pce_diagnostics",
    """-- doubles: rmse mae max_abs relative_l2 q2 mean_prediction mean_reference var_prediction var_reference
    with f as (select mean as p, truth as r from pred_truth) select sqrt(avg((p - r) * (p - r))) as rmse, avg(abs(p - r)) as mae, max(abs(p - r)) as max_abs, sqrt(sum((p - r) * (p - r))) / sqrt(sum(r * r)) as relative_l2,
      1 - sum((p - r) * (p - r)) / (var_pop(r) * count(*)) as q2, avg(p) as mean_prediction, avg(r) as mean_reference, var_samp(p) as var_prediction, var_samp(r) as var_reference from f""",
    "pred_truth",
)
def pce_diagnostics(v):
    return X.response_diagnostics(v.pred_truth.select(F.col("mean").alias("prediction"), F.col("truth").alias("reference")))
