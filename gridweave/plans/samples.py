"""Queries of per-sample quantities and field features."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.operators import samples as S
from gridweave.plans.registry import query
from gridweave.sources.views import BACKGROUND

RECEPTORS = [(1, 1), (3, 4), (6, 2)]


def _reference(v):
    return v.reference_field.withColumnRenamed("value", "reference")


@query(
    "qoi_mean_anomaly",
    f"-- doubles: mean_anomaly\nselect sample_id, avg(value - {BACKGROUND}) as mean_anomaly from temperature where row >= 2 and row < 6 and col >= 1 and col < 7 group by sample_id",
    "temperature",
)
def qoi_mean_anomaly(v):
    return S.mean_anomaly(S.roi(v.temperature, 2, 6, 1, 7), BACKGROUND)


@query("roi_filter", "-- doubles: value\nselect * from temperature where row >= 2 and row < 6 and col >= 1 and col < 7", "temperature")
def roi_filter(v):
    return S.roi(v.temperature, 2, 6, 1, 7)


_RECEPTORS = """-- doubles: receptor_001 receptor_002 receptor_003
select sample_id, max(value) filter (row = 1 and col = 1) as receptor_001, max(value) filter (row = 3 and col = 4) as receptor_002,
  max(value) filter (row = 6 and col = 2) as receptor_003 from temperature group by sample_id"""


@query("qoi_receptors", _RECEPTORS, "temperature")
def qoi_receptors(v):
    return S.receptors(v.temperature, RECEPTORS)


_WARM = f"""-- doubles: max_anomaly area_m2
select sample_id, max(value - {BACKGROUND}) as max_anomaly, count(*) filter ((value - {BACKGROUND})::float > 0.5::float) * 25.0 as area_m2
from temperature group by sample_id"""


@query("qoi_roi_max_anomaly", _WARM, "temperature")
def warming(v):
    return S.warming(v.temperature, BACKGROUND, 0.5, 5.0)


@query(
    "regional_deviation",
    """-- doubles: max_abs rms mean
    select f.sample_id, max(abs(f.value - r.value)) as max_abs, sqrt(avg((f.value - r.value) * (f.value - r.value))) as rms, avg(f.value - r.value) as mean
    from fields_long f join reference_field r on f.row = r.row and f.col = r.col group by f.sample_id""",
    "fields_long reference_field",
)
def regional_deviation(v):
    return S.regional_deviation(v.fields_long, _reference(v))


@query(
    "join_reference_residual",
    "-- doubles: residual\nselect f.sample_id, f.row, f.col, f.value - r.value as residual from fields_long f join reference_field r on f.row = r.row and f.col = r.col",
    "fields_long reference_field",
)
def join_reference_residual(v):
    return v.fields_long.join(_reference(v), ["row", "col"]).select("sample_id", "row", "col", (F.col("value") - F.col("reference")).alias("residual"))


_NEAR = """near as (select *, lag(value) over (partition by sample_id, col order by row) as up,
  lag(value) over (partition by sample_id, row order by col) as "left" from fields_long)"""
_FEATURES = f"""-- doubles: mean std q05 q50 q95 gradient_y gradient_x lag1_y lag1_x
with {_NEAR} select sample_id, avg(value) as mean, stddev_samp(value) as std, quantile_cont(value, 0.05) as q05, quantile_cont(value, 0.5) as q50,
  quantile_cont(value, 0.95) as q95, sqrt(avg(((value - up) / 5) * ((value - up) / 5))) as gradient_y,
  sqrt(avg(((value - "left") / 5) * ((value - "left") / 5))) as gradient_x, coalesce(corr(value, up), 0) as lag1_y, coalesce(corr(value, "left"), 0) as lag1_x
from near group by sample_id"""
for _name in ("field_features", "native_short_range_features"):

    @query(_name, _FEATURES, "fields_long")
    def field_features(v, undefined=None if _name == "native_short_range_features" else 0.0):
        return S.field_features(v.fields_long, 5.0, undefined)


@query(
    "structural_features",
    f"""-- doubles: variance q10 q50 q90 gradient_y gradient_x low_fraction high_fraction
    with {_NEAR} select sample_id, var_pop(value) as variance, quantile_cont(value, 0.1) as q10, quantile_cont(value, 0.5) as q50, quantile_cont(value, 0.9) as q90,
      sqrt(avg((value - up) * (value - up))) as gradient_y, sqrt(avg((value - "left") * (value - "left"))) as gradient_x,
      avg((value <= -0.1)::double) as low_fraction, avg((value >= 0.1)::double) as high_fraction from near group by sample_id""",
    "fields_long",
)
def structural_features(v):
    return S.structural_features(v.fields_long, -0.1, 0.1)


@query(
    "field_agreement",
    """-- doubles: bias rmse mae max_abs correlation median_ratio within_10_percent
    select f.sample_id, avg(f.value - r.value) as bias, sqrt(avg((f.value - r.value) * (f.value - r.value))) as rmse, avg(abs(f.value - r.value)) as mae,
      max(abs(f.value - r.value)) as max_abs, least(1.0, greatest(-1.0, corr(f.value, r.value))) as correlation,
      quantile_cont(pow(10.0, f.value - r.value), 0.5) as median_ratio, avg((abs(pow(10.0, f.value - r.value) - 1) <= 0.1)::double) as within_10_percent
    from fields_long f join reference_field r on f.row = r.row and f.col = r.col group by f.sample_id""",
    "fields_long reference_field",
)
def field_agreement(v):
    return S.agreement(v.fields_long, _reference(v))


@query(
    "native_marginal",
    """-- doubles: mean std variance min max q01 q05 q50 q95 q99
    select sample_id, avg(value) as mean, stddev_samp(value) as std, var_samp(value) as variance, min(value) as min, max(value) as max,
      quantile_cont(value, 0.01) as q01, quantile_cont(value, 0.05) as q05, quantile_cont(value, 0.5) as q50, quantile_cont(value, 0.95) as q95,
      quantile_cont(value, 0.99) as q99 from log_k group by sample_id""",
    "log_k",
)
def native_marginal(v):
    return S.marginal(v.log_k)


@query(
    "temperature_descriptors",
    f"""-- doubles: range mean_anomaly std gradient_rms plume_fraction centroid_row centroid_col
    with near as (select *, lag(value) over (partition by sample_id, col order by row) as up,
      lag(value) over (partition by sample_id, row order by col) as "left" from temperature)
    select sample_id, max(value) - min(value) as range, avg(value - {BACKGROUND}) as mean_anomaly, stddev_pop(value) as std,
      sqrt((avg((value - up) * (value - up)) + avg((value - "left") * (value - "left"))) / 2) as gradient_rms,
      avg((abs(value - {BACKGROUND}) >= 0.5)::double) as plume_fraction, avg(row) filter (abs(value - {BACKGROUND}) >= 0.5) as centroid_row,
      avg(col) filter (abs(value - {BACKGROUND}) >= 0.5) as centroid_col, min(row) filter (abs(value - {BACKGROUND}) >= 0.5) as row_min,
      max(row) filter (abs(value - {BACKGROUND}) >= 0.5) as row_max, min(col) filter (abs(value - {BACKGROUND}) >= 0.5) as col_min,
      max(col) filter (abs(value - {BACKGROUND}) >= 0.5) as col_max from near group by sample_id""",
    "temperature",
)
def temperature_descriptors(v):
    return S.plume(v.temperature, BACKGROUND, 0.5)


@query(
    "flow_descriptors",
    """-- doubles: q01 q50 q99 max_speed mean_u mean_v
    select a.sample_id, quantile_cont(sqrt(a.value * a.value + b.value * b.value), 0.01) as q01, quantile_cont(sqrt(a.value * a.value + b.value * b.value), 0.5) as q50,
      quantile_cont(sqrt(a.value * a.value + b.value * b.value), 0.99) as q99, max(sqrt(a.value * a.value + b.value * b.value)) as max_speed,
      avg(a.value) as mean_u, avg(b.value) as mean_v
    from fields_long a join fields_long b on a.sample_id = b.sample_id and a.row = b.col and a.col = b.row group by a.sample_id""",
    "fields_long",
)
def flow_descriptors(v):
    other = v.fields_long.select("sample_id", F.col("col").alias("row"), F.col("row").alias("col"), F.col("value").alias("other"))
    return S.flow(v.fields_long, other)


@query(
    "sample_error_metrics",
    """-- doubles: log10_rmse relative_rmse_percent absolute_rmse
    select f.sample_id, sqrt(avg((f.value - r.value) * (f.value - r.value))) as log10_rmse,
      100 * sqrt(avg((pow(10.0, f.value - r.value) - 1) * (pow(10.0, f.value - r.value) - 1))) as relative_rmse_percent,
      sqrt(avg((pow(10.0, f.value) - pow(10.0, r.value)) * (pow(10.0, f.value) - pow(10.0, r.value)))) as absolute_rmse
    from fields_long f join reference_field r on f.row = r.row and f.col = r.col group by f.sample_id""",
    "fields_long reference_field",
)
def sample_error_metrics(v):
    return S.sample_errors(v.fields_long, _reference(v))


@query(
    "outside_range_fraction",
    """-- doubles: outside_fraction
    select sample_id, avg((value < -0.2 or value > 0.2)::double) as outside_fraction from fields_long group by rollup (sample_id)""",
    "fields_long",
)
def outside_range_fraction(v):
    return S.outside_range(v.fields_long, -0.2, 0.2)


@query(
    "normalization_bounds_fraction",
    """-- doubles: below above below_crop above_crop
    select sample_id, avg((value < -0.2)::double) as below, avg((value > 0.2)::double) as above,
      avg((value < -0.2)::double) filter (row between 2 and 5 and col between 2 and 5) as below_crop,
      avg((value > 0.2)::double) filter (row between 2 and 5 and col between 2 and 5) as above_crop from fields_long group by sample_id""",
    "fields_long",
)
def normalization_bounds_fraction(v):
    inside = F.col("row").between(2, 5) & F.col("col").between(2, 5)
    low, high = (F.col("value") < -0.2).cast("double"), (F.col("value") > 0.2).cast("double")
    return v.fields_long.groupBy("sample_id").agg(
        F.avg(low).alias("below"), F.avg(high).alias("above"), F.avg(F.when(inside, low)).alias("below_crop"), F.avg(F.when(inside, high)).alias("above_crop")
    )


@query(
    "gradient_adjacent",
    """-- doubles: dy dx
    select sample_id, row, col, (value - lag(value) over (partition by sample_id, col order by row)) / 5 as dy,
      (value - lag(value) over (partition by sample_id, row order by col)) / 5 as dx from fields_long""",
    "fields_long",
)
def gradient_adjacent(v):
    near = S._neighbours(v.fields_long)
    return near.select("sample_id", "row", "col", ((F.col("value") - F.col("up")) / 5).alias("dy"), ((F.col("value") - F.col("left")) / 5).alias("dx"))


def _central(axis: str, other: str) -> str:
    w = f"(partition by sample_id, {other} order by {axis})"
    return f"coalesce((lead(value) over {w} - lag(value) over {w}) / 10, (lead(value) over {w} - value) / 5, (value - lag(value) over {w}) / 5)"


@query(
    "gradient_central",
    f"""-- doubles: value gy gx magnitude
    select *, sqrt(gy * gy + gx * gx) as magnitude from (select *, {_central("row", "col")} as gy, {_central("col", "row")} as gx from fields_long)""",
    "fields_long",
)
def gradient_central(v):
    return S.gradients_central(v.fields_long, 5.0)


_LATTICE = """select i::int as patch, ((i * 2) // 4 * 2)::int as row0, ((i * 2) % 4)::int as col0 from range(4) t(i)"""


@query(
    "patch_lattice",
    f"""with lattice as ({_LATTICE}), cells as (select floor(y_m / 1600)::int as r, floor(x_m / 1600)::int as c, count(*) as n from points group by r, c)
    select patch, row0, col0, coalesce(sum(n), 0)::bigint as points from lattice left join cells on r >= row0 and r < row0 + 4 and c >= col0 and c < col0 + 4 group by patch, row0, col0""",
    "points",
)
def patch_lattice(v):
    """Each patch of the grid with the points on it, which are counted by cell first."""
    cell = [F.floor(F.col(c) / 1600).cast("int").alias(n) for c, n in (("y_m", "r"), ("x_m", "c"))]
    cells = v.points.groupBy(*cell).agg(F.count("*").alias("n"))
    on = (F.col("r") >= F.col("row0")) & (F.col("r") < F.col("row0") + 4) & (F.col("c") >= F.col("col0")) & (F.col("c") < F.col("col0") + 4)
    return S.patch_lattice(v.spark, 8, 8, 4, 2).join(cells, on, "left").groupBy("patch", "row0", "col0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("points"))


_PATCHES = f"""-- doubles: mean std
with patches as ({_LATTICE}) select f.sample_id, p.patch, avg(value) as mean, stddev_samp(value) as std from fields_long f join patches p
on row >= row0 and row < row0 + 4 and col >= col0 and col < col0 + 4 group by f.sample_id, p.patch"""


@query("patch_features", _PATCHES, "fields_long")
def patch_features(v):
    return S.patch_features(v.fields_long, S.patch_lattice(v.spark, 8, 8, 4, 2), 4)
