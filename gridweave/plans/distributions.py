"""Queries of distribution comparison, selection and response models."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from gridweave.functions import scalars as S
from gridweave.operators import distributions as D, samples
from gridweave.plans.registry import query


@query(
    "wasserstein_1d",
    """-- doubles: w1
    with c as (select row, col, value, (sample_id % 2 = 0)::int as x, (sample_id % 2 = 1)::int as y from fields_long),
    r as (select row, col, value, sum(x) over w / (sum(x) over p)::double as f, sum(y) over w / (sum(y) over p)::double as g, lead(value) over (partition by row, col order by value) - value as width
      from (select row, col, value, sum(x) as x, sum(y) as y from c group by all) window w as (partition by row, col order by value), p as (partition by row, col))
    select row, col, coalesce(sum(abs(f - g) * width), 0) as w1 from r group by row, col""",
    "fields_long",
)
def wasserstein_1d(v):
    f = v.fields_long
    return D.wasserstein(f.where("sample_id % 2 = 0"), f.where("sample_id % 2 = 1"), ("row", "col"))


@query(
    "histogram_density",
    """-- doubles: density
    select *, count / (sum(count) over () * (1.2 / 60)) as density from (select least(floor((value + 0.6) / (1.2 / 60)), 59)::int as bin, count(*) as count from fields_long where value between -0.6 and 0.6 group by 1)""",
    "fields_long",
    digits=4,
)
def histogram_density(v):
    return D.histogram(v.fields_long, -0.6, 0.6, 60)


@query("ecdf_at_edges", '-- doubles: edge share\nselect row, col, edge, avg((value <= edge)::int::double) as "share" from fields_long, (select unnest([-0.2, 0.0, 0.2])::double as edge) group by all'.replace("edge share", 'edge "share"'), "fields_long")
def ecdf_at_edges(v):
    return D.ecdf(v.fields_long, [-0.2, 0.0, 0.2], ("row", "col"))


@query(
    "marginal_validation",
    """-- doubles: mean std mean_error std_error inside below above q01 q05 q50 q95 q99
    select count(*) as n, avg(value) as mean, stddev_samp(value) as std, avg(value) + 9.3 as mean_error, stddev_samp(value) - 0.125 as std_error, avg((value between -9.6 and -9.0)::int::double) as inside,
      avg((value < -9.6)::int::double) as below, avg((value > -9.0)::int::double) as above, quantile_cont(value, 0.01) as q01, quantile_cont(value, 0.05) as q05, quantile_cont(value, 0.5) as q50,
      quantile_cont(value, 0.95) as q95, quantile_cont(value, 0.99) as q99, case when abs(avg(value) + 9.3) <= 0.01 and abs(stddev_samp(value) - 0.125) <= 0.01 then 'pass' else 'warn' end as status from log_k""",
    "log_k",
)
def marginal_validation(v):
    return D.marginal_validation(v.log_k, -9.3, 0.125, -9.6, -9.0, 0.01)


@query("normality_metrics", "-- doubles: skewness kurtosis\nselect count(value) as n, skewness(value) as skewness, kurtosis(value) as kurtosis from log_k", "log_k")
def normality_metrics(v):
    return D.normality(v.log_k)


_F = ["mean", "std", "gradient_y", "lag1_y"]
_FSQL = """f as (select sample_id as id, avg(value) as mean, stddev_samp(value) as std, sqrt(avg((value - up) * (value - up))) as gradient_y, coalesce(corr(value, up), 0) as lag1_y
  from (select *, lag(value) over (partition by sample_id, col order by row) as up from fields_long) group by sample_id)"""


def _features(v):
    return samples.field_features(v.fields_long, 1.0).withColumnRenamed("sample_id", "id")


@query(
    "feature_reference",
    f"-- doubles: mean std min max\nwith {_FSQL}, u as (unpivot (select * exclude id from f) on {', '.join(_F)} into name metric value value) select metric, avg(value) as mean, coalesce(stddev_samp(value), 0) as std, min(value) as min, max(value) as max from u group by metric",
    "fields_long",
)
def feature_reference(v):
    return D.feature_reference(_features(v), _F)


@query(
    "feature_comparison",
    f"""-- doubles: ref_mean ref_std mean std outside_fraction z_score
    with {_FSQL}, u as (unpivot f on {', '.join(_F)} into name metric value value),
    r as (select metric, avg(value) as ref_mean, coalesce(stddev_samp(value), 0) as ref_std, min(value) as lo, max(value) as hi from u where id < 100 group by metric)
    select metric, ref_mean, ref_std, avg(value) as mean, coalesce(stddev_samp(value), 0) as std, avg((value < lo or value > hi)::int::double) as outside_fraction, (avg(value) - ref_mean) / ref_std as z_score
    from u join r using (metric) where id >= 100 group by metric, ref_mean, ref_std""",
    "fields_long",
)
def feature_comparison(v):
    f = _features(v)
    return D.feature_comparison(f.where("id >= 100"), f.where("id < 100"), _F)


@query(
    "join_closest_training",
    f"""-- doubles: distance
    with {_FSQL}, s as (select stddev_samp(mean) as s1, stddev_samp(std) as s2, stddev_samp(gradient_y) as s3, stddev_samp(lag1_y) as s4 from f where id < 100),
    d as (select g.id, t.id as train_id, round(sqrt(pow((g.mean - t.mean) / s1, 2) + pow((g.std - t.std) / s2, 2) + pow((g.gradient_y - t.gradient_y) / s3, 2) + pow((g.lag1_y - t.lag1_y) / s4, 2)), 12) as distance
      from f g, f t, s where g.id >= 100 and t.id < 100)
    select id, arg_min(train_id, (distance, train_id)) as train_id, min(distance) as distance from d group by id""",
    "fields_long",
)
def join_closest_training(v):
    f = _features(v).select("id", *_F)
    return D.closest_by_features(f.where("id >= 100"), f.where("id < 100"), _F)


_PROBES = [(0, 0), (0, 4), (4, 0), (7, 7)]
_WIDE = ", ".join(f"max(value) filter (row = {r} and col = {c}) as p{k}" for k, (r, c) in enumerate(_PROBES))
_COVS = " union all ".join(f"select {i} as a, {j} as b, covar_samp(p{i}, p{j}) as covariance, corr(p{i}, p{j}) as correlation from w" for i in range(4) for j in range(i, 4))


@query("covariance_matrix_probes", f"-- doubles: covariance correlation\nwith w as (select sample_id, {_WIDE} from fields_long group by sample_id) {_COVS}", "fields_long")
def covariance_matrix_probes(v):
    return D.probe_covariance(v.fields_long, _PROBES)


@query(
    "probe_prefix_convergence",
    "-- doubles: c01\nselect budget, covar_samp(p0, p1) as c01, count(*) as n from (select sample_id, " + _WIDE + " from fields_long group by sample_id), budgets where sample_id < budget group by budget",
    "fields_long budgets",
)
def probe_prefix_convergence(v):
    f = v.fields_long
    wide = f.groupBy("sample_id").agg(*(F.max(F.when((F.col("row") == r) & (F.col("col") == c), F.col("value"))).alias(f"p{k}") for k, (r, c) in enumerate(_PROBES)))
    return wide.join(F.broadcast(v.budgets), F.col("sample_id") < F.col("budget")).groupBy("budget").agg(F.covar_samp("p0", "p1").alias("c01"), F.count("*").alias("n"))


_RMS = "select a.sample_id as a, b.sample_id as b, sqrt(avg((a.value - b.value) * (a.value - b.value))) as rms from fields_long a join fields_long b on a.row = b.row and a.col = b.col and a.sample_id < b.sample_id group by all"


@query("pairwise_rms", "-- doubles: rms\n" + _RMS, "fields_long", rounds=True)
def pairwise_rms(v):
    return D.pairwise_rms(v.fields_long, digits=6)


@query("pair_rms_checkpoints", f"-- doubles: median_rms max_rms\nselect n, median(rms) as median_rms, max(rms) as max_rms from ({_RMS}), (select unnest([10, 40, 160]) as n union all select max(sample_id) + 1 from fields_long) where b < n group by n", "fields_long")
def pair_rms_checkpoints(v):
    """Pairs of the first draws by rows, those of all draws by counting passes: the last mark has them all."""
    first, last = (10, 40, 160), v.fields_long.agg((F.max("sample_id") + 1).alias("n")).first()["n"]
    marks = v.rows([(n,) for n in first], "n long")
    rms = D.pairwise_rms(v.fields_long.where(F.col("sample_id") < max(first)))
    few = rms.join(F.broadcast(marks), F.col("b") < F.col("n")).groupBy("n").agg(F.median("rms").alias("median_rms"), F.max("rms").alias("max_rms"))
    if last is None or last in first:
        return few
    whole = D.pair_rms_summary(v.fields_long).where("max_rms is not null")
    return few.unionByName(whole.select(F.lit(last).cast("long").alias("n"), "median_rms", "max_rms"))


@query(
    "criteria_assessment",
    """-- doubles: bias spread
    with c as (select stratum, avg(log10_k) as bias, case when count(*) % 2 = 0 then stddev_samp(log10_k) end as spread from good_points group by stratum)
    select *, abs(bias) <= 0.45 as ok_bias, abs(spread) <= 0.5 as ok_spread, case when abs(bias) > 0.45 or coalesce(abs(spread) > 0.5, false) then 'fail' when spread is null then 'unknown' else 'pass' end as status from c""",
    "good_points",
)
def criteria_assessment(v):
    c = v.good_points.groupBy("stratum").agg(F.avg("log10_k").alias("bias"), F.when(F.count("*") % 2 == 0, F.stddev_samp("log10_k")).alias("spread"))
    return D.criteria(c, {"bias": 0.45, "spread": 0.5})


@query(
    "scenario_matrix",
    "select status, priority, draws from (select distinct o_orderstatus as status from orders), (select distinct o_orderpriority as priority from orders), (select unnest([8, 32])::int as draws)",
)
def scenario_matrix(v):
    """Every status with every priority that orders have, for two numbers of draws."""
    levels = lambda c: [r[0] for r in v.table("orders").select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(1000).collect()]
    return D.scenario_matrix(v.spark, {"status": levels("o_orderstatus"), "priority": levels("o_orderpriority"), "draws": [8, 32]})


@query("scenario_weights", "-- doubles: weight\nselect n_nationkey, 1.0 / count(*) over () as weight from nation")
def scenario_weights(v):
    return v.table("nation").select("n_nationkey", (1.0 / F.count("*").over(W.partitionBy())).alias("weight"))


@query("total_degree_multi_index", "select concat(a, ',', b, ',', c) as alpha, (a + b + c)::int as degree from range(4) x(a), range(4) y(b), range(4) z(c) where a + b + c <= (select max(p_size % 4) from part)")
def total_degree_multi_index(v):
    """Multi-indices of three dimensions up to the largest degree that parts ask for."""
    degree = v.table("part").agg(F.max(F.col("p_size") % 4)).first()[0] or 0
    return D.total_degree(v.spark, 3, degree).select(F.array_join(F.transform("alpha", lambda x: x.cast("string")), ",").alias("alpha"), "degree")


def _basis(x):
    return [S.legendre(x, n) for n in range(3)]


_P = "p as (select id, 2 * k - 1 as x, log10_k as y from good_points), b as (select id, y, 1.0::double as b0, x * sqrt(3.0::double) as b1, (1.5 * x * x - 0.5) * sqrt(5.0::double) as b2 from p)"


def _design(v):
    return v.good_points.select("id", (2 * F.col("k") - 1).alias("x"), F.col("log10_k").alias("y"))


@query(
    "pce_fit",
    f"-- doubles: value\nwith {_P} "
    + " union all ".join([f"select {i} as i, {j} as j, sum(b{i} * b{j}) as value from b" for i in range(3) for j in range(i, 3)] + [f"select {i}, null, sum(b{i} * y) from b" for i in range(3)]),
    "good_points",
)
def pce_fit(v):
    return D.normal_equations(_design(v), _basis(F.col("x")), F.col("y"))


_SOLVE = f"""with {_P}, s as (select sum(b0*b0) as a00, sum(b0*b1) as a01, sum(b0*b2) as a02, sum(b1*b1) as a11, sum(b1*b2) as a12, sum(b2*b2) as a22, sum(b0*y) as r0, sum(b1*y) as r1, sum(b2*y) as r2 from b),
d as (select *, a00*(a11*a22-a12*a12) - a01*(a01*a22-a12*a02) + a02*(a01*a12-a11*a02) as det from s),
c as (select (r0*(a11*a22-a12*a12) - a01*(r1*a22-a12*r2) + a02*(r1*a12-a11*r2)) / det as c0, (a00*(r1*a22-a12*r2) - r0*(a01*a22-a12*a02) + a02*(a01*r2-r1*a02)) / det as c1,
  (a00*(a11*r2-r1*a12) - a01*(a01*r2-r1*a02) + r0*(a01*a12-a11*a02)) / det as c2 from d)"""


@query("pce_predict", f"-- doubles: y\n{_SOLVE} select id, c0 * b0 + c1 * b1 + c2 * b2 as y from b, c", "good_points", digits=5)
def pce_predict(v):
    x = _design(v)
    found = D.solve_normal(D.normal_equations(x, _basis(F.col("x")), F.col("y")))
    return x.select("id", D.predicted(_basis(F.col("x")), found).alias("y"))


@query("pce_moments", f"-- doubles: mean variance\n{_SOLVE} select c0 as mean, c1 * c1 + c2 * c2 as variance from c", "good_points", digits=5)
def pce_moments(v):
    x = _design(v)
    return v.rows([D.response_moments(D.solve_normal(D.normal_equations(x, _basis(F.col("x")), F.col("y"))))], "mean double, variance double")


@query("iid_normal_model", "-- doubles: mean variance\nselect avg(log10_k) as mean, var_samp(log10_k) * (1 + 1.0 / count(*)) as variance from good_points", "good_points")
def iid_normal_model(v):
    return v.good_points.agg(F.avg("log10_k").alias("mean"), (F.var_samp("log10_k") * (1 + 1.0 / F.count("*"))).alias("variance"))


@query(
    "kl_mode_select",
    """-- doubles: energy
    with y as (select row as i, 100 * var_pop(value) as value from fields_long group by row), x as (select col as i, 100 * var_pop(value) as value from fields_long group by col),
    m as (select y.i as iy, x.i as ix, y.value * x.value as energy from y, x),
    r as (select *, row_number() over (order by energy desc, iy, ix)::int as mode, sum(energy) over (order by energy desc, iy, ix rows unbounded preceding) as run, sum(energy) over () as total from m)
    select mode, iy, ix, energy from r where run - energy < 0.9 * total""",
    "fields_long",
)
def kl_mode_select(v):
    """Pairs of grid lines by the product of the ensemble's variances along them, up to a share of the whole."""
    line = lambda axis: v.fields_long.groupBy(F.col(axis).alias("i")).agg((100 * F.var_pop("value")).alias("value"))
    return D.energy_modes(line("row"), line("col"), 0.9)


@query("kl_variance", "-- doubles: variance\nselect row, col, sum(value * value * (1.0 / (1 + sample_id))) as variance from fields_long group by row, col", "fields_long")
def kl_variance(v):
    """Retained variance of a cell: squared modes times their energies; fields stand for modes."""
    return v.fields_long.groupBy("row", "col").agg(F.sum(F.col("value") * F.col("value") / (1 + F.col("sample_id"))).alias("variance"))


@query("normal_score_fit", "-- doubles: value p\nselect k::int as k, (k + 0.5) / 20 as p, (select quantile_cont(value, (k + 0.5) / 20) from log_k) as value from range(20) t(k)".replace("(select quantile_cont(value, (k + 0.5) / 20) from log_k)", "qs[k + 1]").replace("from range(20) t(k)", "from range(20) t(k), (select quantile_cont(value, [" + ", ".join(str((i + 0.5) / 20) for i in range(20)) + "]) as qs from log_k)"), "log_k")
def normal_score_fit(v):
    return D.knots(v.log_k, 20)


_KNOTS = [(-9.6, -2.0), (-9.4, -0.8), (-9.2, 0.8), (-9.0, 2.0)]
_TO = "case when value <= -9.6 then -2.0 when value <= -9.4 then -2 + (value + 9.6) * 6.0 when value <= -9.2 then -0.8 + (value + 9.4) * 8.0 when value <= -9.0 then 0.8 + (value + 9.2) * 6.0 else 2.0 end"


@query("normal_score_to", f"-- doubles: z\nselect sample_id, row, col, {_TO} as z from log_k", "log_k", digits=5)
def normal_score_to(v):
    return v.log_k.select("sample_id", "row", "col", S.interpolated(F.col("value"), _KNOTS).alias("z"))


@query("normal_score_from", f"-- doubles: y\nselect sample_id, row, col, case when z <= -2 then -9.6 when z <= -0.8 then -9.6 + (z + 2) / 6.0 when z <= 0.8 then -9.4 + (z + 0.8) / 8.0 when z <= 2 then -9.2 + (z - 0.8) / 6.0 else -9.0 end as y from (select sample_id, row, col, {_TO} as z from log_k)", "log_k", digits=5)
def normal_score_from(v):
    z = v.log_k.withColumn("z", S.interpolated(F.col("value"), _KNOTS))
    return z.select("sample_id", "row", "col", S.interpolated(F.col("z"), [(b, a) for a, b in _KNOTS]).alias("y"))


@query(
    "simple_kriging_grid",
    """-- doubles: mean
    select q.id, -0.4 + sum(o.log10_k / 10 * exp(-sqrt((q.x_m - o.x_m) * (q.x_m - o.x_m) + (q.y_m - o.y_m) * (q.y_m - o.y_m)) / 900)) as mean from points q, good_points o group by q.id""",
    "good_points",
)
def simple_kriging_grid(v):
    weights = v.good_points.select(F.col("x_m").alias("ox"), F.col("y_m").alias("oy"), (F.col("log10_k") / 10).alias("alpha"))
    return D.simple_kriging_mean(v.points, weights, -0.4, 900.0)


@query("mc_propagate", "-- doubles: mean std\nselect row, col, avg(t) as mean, stddev_samp(t) as std from (select row, col, 10.6 + 4 * exp(log10(value) + 9.3) as t from permeability) group by row, col", "permeability")
def mc_propagate(v):
    """A surrogate as a column expression, then statistics of what it gives."""
    from gridweave.operators.cells import field_statistics

    t = v.permeability.withColumn("value", 10.6 + 4 * F.exp(F.log10("value") + 9.3))
    return field_statistics(t).select("row", "col", "mean", "std")


def _parts(v):
    return v.table("part").groupBy(F.col("p_brand").alias("model")).agg(F.round(F.avg("p_retailprice"), 6).alias("score"), F.min("p_size").alias("order"))


_PARTS = 'm as (select p_brand as model, round(avg(p_retailprice), 6) as score, min(p_size) as "order" from part group by p_brand)'
for _name in ("sort_candidates_by_rmse", "rank_covariances"):

    @query(_name, f'-- doubles: score\nwith {_PARTS} select model, score, row_number() over (order by score, "order", model)::int as rank from m')
    def sort_candidates(v):
        return _parts(v).select("model", "score", F.row_number().over(W.orderBy("score", "order", "model")).alias("rank"))


@query("argmin_model", f'with {_PARTS} select arg_min(model, (score, "order", model)) as model from m')
def argmin_model(v):
    return _parts(v).agg(F.min_by("model", F.struct("score", "order", "model")).alias("model"))


@query("topk_coarse_matches", "select * from (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice, p_size, p_partkey)::int as rank from part) where rank <= 3")
def topk_per_group(v):
    w = W.partitionBy("p_brand").orderBy("p_retailprice", "p_size", "p_partkey")
    return v.table("part").select("p_brand", "p_partkey", F.row_number().over(w).alias("rank")).where("rank <= 3")


@query("measurement_prefix", "select position, p_partkey from (select row_number() over (order by p_partkey)::int as position, p_partkey from part) where position <= 64")
def measurement_prefix(v):
    return v.table("part").select(F.row_number().over(W.orderBy("p_partkey")).alias("position"), "p_partkey").where("position <= 64")


_PARTS = "(select count(*) as n from part)"


@query("even_midpoint_sample", f"select least(floor(0.5 * (floor(i * n / 50.0) + floor((i + 1) * n / 50.0))), n - 1)::bigint as position from range(50) t(i), {_PARTS}")
def even_midpoint_sample(v):
    """Fifty positions in the middle of equal stretches of the parts."""
    n, cut = v.table("part").count(), lambda x: F.floor(x / 50.0)
    i = F.col("id")
    return v.spark.range(50).select(F.least(F.floor(0.5 * (cut(i * n) + cut((i + 1) * n))), F.lit(n - 1)).cast("bigint").alias("position"))


@query("bounded_linspace_sample", f"select least(floor(i * (n - 1) / 49.0), n - 1)::bigint as position from range(50) t(i), {_PARTS}")
def bounded_linspace_sample(v):
    """Fifty positions from the first to the last of the parts."""
    n = v.table("part").count()
    return v.spark.range(50).select(F.least(F.floor(F.col("id") * (n - 1) / 49.0), F.lit(n - 1)).cast("bigint").alias("position"))


@query("historical_window", "-- doubles: value\nselect sample_id, (6 - col)::int as row, (row - 1)::int as col, log10(pow(10.0, value) * 7.5e6) as value from fields_long where row between 1 and 6 and col between 1 and 6", "fields_long")
def historical_window(v):
    """A window turned by 90 degrees, converted by the historical divisor."""
    from gridweave.operators.spatial import orient

    w = v.fields_long.where("row between 1 and 6 and col between 1 and 6").withColumns({"row": F.col("row") - 1, "col": F.col("col") - 1})
    turned = orient(w, "transpose_flip_y", 6, 6)
    return turned.select("sample_id", "row", "col", F.log10(F.pow(F.lit(10.0), "value") * S.HISTORICAL_DIVISOR).alias("value"))
