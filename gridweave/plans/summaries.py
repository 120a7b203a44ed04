"""Queries of summaries, risk, convergence and method comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.operators import cells as C, samples as S, summaries as X
from gridweave.plans.registry import query
from gridweave.sources.views import BACKGROUND

_QOI = f"qoi as (select sample_id, avg(value - {BACKGROUND}) as value from temperature group by sample_id)"
_SUMMARY = """count(value) as count, avg(value) as mean, coalesce(stddev_samp(value), 0) as sd, quantile_cont(value, 0.05) as q05,
  quantile_cont(value, 0.5) as q50, quantile_cont(value, 0.95) as q95"""


def _qoi(v):
    return S.mean_anomaly(v.temperature, BACKGROUND).withColumnRenamed("mean_anomaly", "value")


@query("scalar_summary", f"-- doubles: mean sd q05 q50 q95\nwith {_QOI} select {_SUMMARY} from qoi", "temperature")
def scalar_summary(v):
    return X.scalar_summary(_qoi(v))


@query(
    "global_uncertainty",
    """-- doubles: u_rms u95 mean_std max_std
    select sqrt(avg(s * s)) as u_rms, quantile_cont(s, 0.95) as u95, avg(s) as mean_std, max(s) as max_std
    from (select stddev_samp(value) as s from temperature group by row, col)""",
    "temperature",
)
def global_uncertainty(v):
    return X.global_uncertainty(C.field_statistics(v.temperature))


_RISK = f"""count(*) filter (value - {BACKGROUND} > 0.5) as exceed_count, avg((value - {BACKGROUND} > 0.5)::double) as probability,
  avg(greatest(value - {BACKGROUND} - 0.5, 0)) as expected_excess, avg(value - {BACKGROUND} - 0.5) filter (value - {BACKGROUND} > 0.5) as conditional_excess"""


@query("receptor_risk", f"-- doubles: probability expected_excess conditional_excess\nselect row, col, {_RISK} from temperature where row = col group by row, col", "temperature")
def receptor_risk(v):
    return X.receptor_risk(v.temperature.where("row = col"), BACKGROUND, 0.5, ("row", "col"))


@query(
    "receptor_metric_rows",
    f"-- doubles: probability expected_excess conditional_excess\nselect budget, row, col, {_RISK} from temperature, budgets where row = col and sample_id < budget group by all",
    "temperature budgets",
)
def receptor_metric_rows(v):
    return X.receptor_risk(X.prefix_fields(v.temperature.where("row = col"), v.budgets), BACKGROUND, 0.5, ("budget", "row", "col"))


@query(
    "tail_risk",
    f"""-- doubles: value_at_risk expected_shortfall
    with {_QOI}, q as (select quantile_disc(value, 0.9) as value_at_risk from qoi)
    select value_at_risk, value_at_risk + avg(greatest(value - value_at_risk, 0)) / (1 - 0.9::double) as expected_shortfall from qoi, q group by value_at_risk""",
    "temperature",
)
def tail_risk(v):
    return X.tail_risk(_qoi(v), 0.9)


@query(
    "prefix_quantile",
    f"-- doubles: q\nwith {_QOI} select budget, quantile_disc(value, 0.9) as q from qoi, budgets where sample_id < budget group by budget",
    "temperature budgets",
)
def prefix_quantile(v):
    rows = X.prefix_fields(_qoi(v), v.budgets)
    return rows.groupBy("budget").agg(F.expr("percentile_disc(0.9) within group (order by value)").alias("q"))


@query(
    "quantile_interval",
    f"""-- doubles: lower upper
    with {_QOI}, size as (select count(*) as n from qoi), each as (select n::double as n, unnest(range(0, n + 1))::double as k from size),
    cdf as (select n, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.9::double) + (n - k) * ln(0.1::double))) over (order by k) as c from each),
    ends as (select min(k) filter (c >= 0.025) as low, min(k) filter (c >= 0.975) + 1 as high from cdf),
    r as (select value, row_number() over (order by value) as k from qoi)
    select max(value) filter (k = low) as lower, max(value) filter (k = high) as upper from r, ends""",
    "temperature",
)
def quantile_interval(v):
    return X.quantile_interval(_qoi(v), 0.9, 0.95)


_CASES = "cases as (select l_linenumber as n, avg(abs(l_discount - 0.05)) / l_linenumber as estimate, avg(abs(l_discount - 0.05)) / l_linenumber + 0.003 as upper from lineitem group by l_linenumber)"


@query(
    "stopping_table",
    f"""-- doubles: "limit"
    with {_CASES}, limits as (select unnest([0.004, 0.01, 0.02, 0.0001])::double as "limit")
    select "limit", min(n) as first_estimate, min(n) filter (upper <= "limit") as first_upper from limits left join cases on estimate <= "limit" group by "limit" """,
)
def stopping_table(v):
    error = F.avg(F.abs(F.col("l_discount") - 0.05)) / F.col("n")
    cases = v.table("lineitem").withColumn("n", F.col("l_linenumber")).groupBy("n").agg(error.alias("estimate"), (error + 0.003).alias("upper"))
    return X.stopping_table(cases, v.rows([(0.004,), (0.01,), (0.02,), (0.0001,)], "`limit` double"))


_GAIN = """-- doubles: rmse_first rmse_second gain
select *, case when rmse_second <> 0 then rmse_first / rmse_second when rmse_first = 0 then 0 else 'inf'::double end as gain from (
  select budget, target, sqrt(avg(error * error) filter (method = 'MC')) as rmse_first, sqrt(avg(error * error) filter (method = 'RQMC')) as rmse_second,
    least(count(*) filter (method = 'MC'), count(*) filter (method = 'RQMC')) as repetitions from trial_errors group by budget, target) where repetitions > 0"""


@query("mc_rqmc_gain", _GAIN, "trial_errors")
def mc_rqmc_gain(v):
    return X.method_gain(v.trial_errors)


@query(
    "mean_sem",
    "-- doubles: mean sd sem\nselect budget, target, avg(error) as mean, stddev_samp(error) as sd, stddev_samp(error) / sqrt(count(error)) as sem from trial_errors group by all",
    "trial_errors",
)
def mean_sem(v):
    return X.mean_sem(v.trial_errors.withColumnRenamed("error", "value"), ("budget", "target"))


_PREFIX = """-- doubles: e_mu e_sigma u_rms u95 mean_std max_std
with ref as (select row, col, avg(value) as m, stddev_samp(value) as s from temperature group by row, col),
own as (select budget, row, col, avg(value) as m, stddev_samp(value) as s from temperature, budgets where sample_id < budget group by all)
select budget, sqrt(avg((o.m - r.m) * (o.m - r.m))) as e_mu, sqrt(avg((o.s - r.s) * (o.s - r.s))) as e_sigma, sqrt(avg(o.s * o.s)) as u_rms,
  quantile_cont(o.s::float::double, 0.95) as u95, avg(o.s) as mean_std, max(o.s) as max_std
from own o join ref r on o.row = r.row and o.col = r.col group by budget"""
for _name in ("prefix_field_convergence", "online_checkpoint_convergence"):

    @query(_name, _PREFIX, "temperature budgets")
    def prefix_field_convergence(v):
        return X.prefix_field_convergence(v.temperature, v.budgets)


_SCALAR = f"""-- doubles: estimate reference error abs_error
with {_QOI}, own as (select budget, {_SUMMARY} from qoi, budgets where sample_id < budget group by budget), every as (select {_SUMMARY} from qoi),
a as (unpivot (select * exclude count from own) on mean, sd, q05, q50, q95 into name statistic value estimate),
b as (unpivot (select * exclude count from every) on mean, sd, q05, q50, q95 into name statistic value reference)
select budget, statistic, estimate, reference, estimate - reference as error, abs(estimate - reference) as abs_error from a join b using (statistic)"""


@query("scalar_prefix_convergence", _SCALAR, "temperature budgets")
def scalar_prefix_convergence(v):
    return X.scalar_prefix_convergence(_qoi(v), v.budgets)


@query(
    "qoi_rows",
    f"""-- doubles: mean_anomaly receptor_001 receptor_002
    select sample_id + 1 as sample_index, avg(value - {BACKGROUND}) as mean_anomaly, max(value) filter (row = 1 and col = 1) as receptor_001,
      max(value) filter (row = 3 and col = 4) as receptor_002 from temperature group by sample_id""",
    "temperature",
)
def qoi_rows(v):
    wide = S.mean_anomaly(v.temperature, BACKGROUND).join(S.receptors(v.temperature, [(1, 1), (3, 4)]), "sample_id")
    return wide.select((F.col("sample_id") + 1).alias("sample_index"), "mean_anomaly", "receptor_001", "receptor_002")


_CONTRAST = """-- doubles: mean sd sem
with cases as (select year(l_shipdate)::varchar as profile, l_linenumber as budget, l_suppkey as trial, avg(l_discount) as value from lineitem group by all)
select a.budget, a.profile, avg(a.value - b.value) as mean, stddev_samp(a.value - b.value) as sd, stddev_samp(a.value - b.value) / sqrt(count(*)) as sem
from cases a join cases b on a.budget = b.budget and a.trial = b.trial and b.profile = '1995' where a.profile <> '1995' group by all"""


@query("profile_contrast", _CONTRAST)
def profile_contrast(v):
    keys = [F.year("l_shipdate").cast("string").alias("profile"), F.col("l_linenumber").alias("budget"), F.col("l_suppkey").alias("trial")]
    return X.paired_contrast(v.table("lineitem").groupBy(*keys).agg(F.avg("l_discount").alias("value")), "1995")


_REDUCE = """-- doubles: value reduction remaining
with cases as (select l_linenumber as budget, (l_suppkey % 4)::int as n, var_samp(l_discount) as value from lineitem group by all)
select c.budget, c.n, c.value, p.value - c.value as reduction, case when p.value <> 0 then c.value / p.value end as remaining
from cases c join cases p on c.budget = p.budget and p.n = 0 where c.n > 0"""


@query("density_reduction", _REDUCE)
def density_reduction(v):
    keys = [F.col("l_linenumber").alias("budget"), (F.col("l_suppkey") % 4).cast("int").alias("n")]
    return X.reduction_from_prior(v.table("lineitem").groupBy(*keys).agg(F.var_samp("l_discount").alias("value")))


@query(
    "half_batch_stats",
    "-- doubles: mean variance\nselect (2 * sample_id > (select max(sample_id) from fields_long))::int as half, row, col, avg(value) as mean, var_samp(value) as variance from fields_long group by all",
    "fields_long",
)
def half_batch_stats(v):
    last = v.fields_long.agg(F.max("sample_id")).first()[0]
    half = (2 * F.col("sample_id") > last).cast("int").alias("half")
    return v.fields_long.groupBy(half, "row", "col").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("variance"))


@query(
    "budget_compare",
    """-- doubles: mean_some mean_all mean_change std_some std_all
    select row, col, avg(value) filter (sample_id < 128) as mean_some, avg(value) as mean_all, avg(value) - avg(value) filter (sample_id < 128) as mean_change,
      stddev_samp(value) filter (sample_id < 128) as std_some, stddev_samp(value) as std_all from fields_long group by row, col""",
    "fields_long",
)
def budget_compare(v):
    some = F.when(F.col("sample_id") < 128, F.col("value"))
    return v.fields_long.groupBy("row", "col").agg(
        F.avg(some).alias("mean_some"), F.avg("value").alias("mean_all"), (F.avg("value") - F.avg(some)).alias("mean_change"), F.stddev_samp(some).alias("std_some"), F.stddev_samp("value").alias("std_all")
    )


@query(
    "spread_summary",
    "-- doubles: low mean high\nselect stratum, min(x) as low, avg(x) as mean, max(x) as high from (select stratum, case when k > 0 then k end as x from points) group by stratum",
    "points",
)
def spread_summary(v):
    x = F.when(F.col("k") > 0, F.col("k"))
    return v.points.groupBy("stratum").agg(F.min(x).alias("low"), F.avg(x).alias("mean"), F.max(x).alias("high"))


@query("union_rows", "select o_orderstatus as s, count(*) as n from (select * from orders union all select * from orders where o_orderkey % 2 = 0) group by s")
def union_rows(v):
    orders = v.table("orders")
    return orders.unionByName(orders.where("o_orderkey % 2 = 0")).groupBy(F.col("o_orderstatus").alias("s")).agg(F.count("*").alias("n"))


@query(
    "sink_csv_union_header",
    "select s_suppkey as k, s_name as name, null::double as acctbal from supplier union all select c_custkey, null, c_acctbal from customer",
)
def sink_csv_union_header(v):
    a = v.table("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    b = v.table("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("acctbal"))
    return a.unionByName(b, allowMissingColumns=True)


@query("sink_temperature_store", "select count(distinct sample_id) as samples, count(*) as cells from temperature", "temperature")
def sink_temperature_store(v):
    return v.temperature.agg(F.count_distinct("sample_id").alias("samples"), F.count("*").alias("cells"))
