"""Queries of fields against targets and training fields, and of rasters at points."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.operators import compatibility as K, samples as S
from gridweave.operators.raster import raster_samples
from gridweave.plans.registry import query

#: A raster of eight rows and columns, from its upper left corner down.
_PIXEL, _TOP = 1500.0, 12000.0
_CORNERS = "".join(
    f" left join r v{i}{j} on v{i}{j}.row = p.r + {i} and v{i}{j}.col = p.c + {j}" for i in (0, 1) for j in (0, 1)
)
_LINEAR = " + ".join(
    f"case when {u} * {w} = 0 then 0 else {u} * {w} * v{i}{j}.value end" for i, u in ((0, "(1 - u)"), (1, "u")) for j, w in ((0, "(1 - w)"), (1, "w"))
)


@query(
    "join_raster_sample",
    f"""-- doubles: linear nearest
    with r as (select row, col, pow(10.0::double, value) as value from reference_field),
    a as (select id, ({_TOP} - y_m) / {_PIXEL} - 0.5 as y, x_m / {_PIXEL} - 0.5 as x from points),
    b as (select *, y between 0 and 7 and x between 0 and 7 as reached from a),
    c as (select id, x, y, case when reached then least(floor(y), 6)::int end as r, case when reached then least(floor(x), 6)::int end as c from b),
    p as (select *, y - r as u, x - c as w from c),
    s as (select p.id, {_LINEAR} as linear, case when u > 0.5 then case when w > 0.5 then v11.value else v10.value end else case when w > 0.5 then v01.value else v00.value end end as nearest from p{_CORNERS})
    select id, linear, nearest, coalesce(linear > 0, false) as linear_valid, coalesce(nearest > 0, false) as nearest_valid from s""",
    "reference_field points",
)
def join_raster_sample(v):
    """A positive raster at all points, linearly between pixel centres and by the nearest of them."""
    raster = v.reference_field.withColumn("value", F.pow(F.lit(10.0), "value"))
    return raster_samples(v.points, raster, (_PIXEL, 0.0, 0.0, 0.0, -_PIXEL, _TOP), 8, 8)


_QUANTILES = ", ".join(f"quantile_cont(value, {p}) as {n}" for n, p in K.LEVELS.items())
_TARGET, _LOW, _HIGH, _LEAST = (-9.3, 0.125), -9.5, -9.1, 0.9
_REPORT = f"""count(*) as n, avg(value) as mean, coalesce(stddev_samp(value), 0) as std, avg((value < {_LOW})::int::double) as below,
  avg((value >= {_LOW} and value <= {_HIGH})::int::double) as inside, avg((value > {_HIGH})::int::double) as above, {_QUANTILES}"""


@query(
    "marginal_accumulator",
    f"""-- doubles: mean std below inside above mean_error std_error {' '.join(K.LEVELS)}
    with m as (select 'pooled' as scope, null::bigint as sample_id, {_REPORT} from log_k union all select 'field', sample_id, {_REPORT} from log_k group by sample_id)
    select *, mean - {_TARGET[0]}::double as mean_error, std - {_TARGET[1]}::double as std_error, case when inside >= {_LEAST} then 'pass' else 'warn' end as status from m""",
    "log_k",
)
def marginal_accumulator(v):
    """The pooled logarithms and those of every field against one target; exact quantiles in place of a reservoir."""
    return K.marginal_report(v.log_k, *_TARGET, _LOW, _HIGH, _LEAST)


_LAGS = [1, 2, 3, 4]
_GAMMA = " union all ".join(
    f"""select '{n}' as part, s.sample_id % 2 = 0 as g, lag, avg((t.value - s.value) * (t.value - s.value)) / 2 as gamma from fields_long s, (select unnest({_LAGS}) as lag) l, fields_long t
    where t.sample_id = s.sample_id and t.row = s.row + {dr} * lag and t.col = s.col + {dc} * lag group by all"""
    for n, (dr, dc) in K.DIRECTIONS.items()
)
_PICKED = ", ".join(f"abs(quantile_cont(value, {p}) filter (g) - quantile_cont(value, {p}) filter (not g)) as {n}_error" for n, p in K.LEVELS.items())


@query(
    "ensemble_fidelity",
    f"""-- doubles: value
    with f as (select value, sample_id % 2 = 0 as g from fields_long),
    c as (select value, count(*) filter (g) as x, count(*) filter (not g) as y from f group by value),
    r as (select lead(value) over (order by value) - value as width, sum(x) over (order by value) / sum(x) over () as p, sum(y) over (order by value) / sum(y) over () as q from c),
    m as (select (select sum(abs(p - q) * width) from r) as w1, avg(value) filter (g) - avg(value) filter (not g) as mean_error, stddev_samp(value) filter (g) - stddev_samp(value) filter (not g) as std_error, {_PICKED} from f),
    s as ({_GAMMA}), k as (select a.part, a.gamma as x, b.gamma as y from s a join s b on a.part = b.part and a.lag = b.lag and a.g and not b.g),
    d as (select part, sqrt(avg((x - y) * (x - y))) as rmse, sqrt(avg((x - y) * (x - y))) / sqrt(avg(y * y)) as relative_rmse, corr(x, y) as curve_correlation from k group by part)
    select 'marginal' as part, statistic, value from (unpivot m on columns(*) into name statistic value value)
    union all select part, statistic, value from (unpivot d on rmse, relative_rmse, curve_correlation into name statistic value value)""",
    "fields_long",
)
def ensemble_fidelity(v):
    """Generated fields (even samples) against the others: W1, moments, quantiles and directional variograms."""
    return K.ensemble_fidelity(v.fields_long, F.col("sample_id") % 2 == 0, _LAGS)


_NAMES = ["mean", "std", "q05", "q50", "q95", "gradient_y", "gradient_x", "lag1_y", "lag1_x"]
_FEATURES = """n as (select sample_id, value, lag(value) over (partition by sample_id, col order by row) as up, lag(value) over (partition by sample_id, row order by col) as west from fields_long),
  f as (select sample_id % 2 = 0 as g, avg(value) as mean, stddev_samp(value) as std, quantile_cont(value, 0.05) as q05, quantile_cont(value, 0.5) as q50, quantile_cont(value, 0.95) as q95,
    sqrt(avg((value - up) * (value - up))) as gradient_y, sqrt(avg((value - west) * (value - west))) as gradient_x, coalesce(corr(value, up), 0) as lag1_y, coalesce(corr(value, west), 0) as lag1_x from n group by sample_id)"""
_STATS = lambda p: f"count(*) as {p}_n, avg(x) as {p}_mean, coalesce(stddev_samp(x), 0) as {p}_std, min(x) as {p}_min, max(x) as {p}_max"


@query(
    "training_compat",
    f"""-- doubles: {' '.join(f'{p}_{s}' for p in ('training', 'generated') for s in ('mean', 'std', 'min', 'max'))} outside z_score
    with {_FEATURES}, l as (unpivot f on {', '.join(_NAMES)} into name metric value x), t as (select metric, {_STATS('training')} from l where not g group by metric)
    select t.*, {_STATS('generated')}, avg((x < training_min or x > training_max)::int::double) as outside, (avg(x) - training_mean) / training_std as z_score from l join t on l.metric = t.metric where g group by t.metric, {', '.join(f't.training_{c}' for c in ('n', 'mean', 'std', 'min', 'max'))}""",
    "fields_long",
)
def training_compat(v):
    """Descriptors of generated fields (even samples) beside those of training fields, by metric; no field is rejected."""
    return K.training_compatibility(S.field_features(v.fields_long, 1.0), F.col("sample_id") % 2 == 0, _NAMES)
