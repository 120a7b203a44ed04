"""Queries of per-cell statistics, sources and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.operators import cells as C, guards as G
from gridweave.plans.registry import query
from gridweave.sources.views import BACKGROUND

THRESHOLDS = [0.1, 0.5]
_STATS = "count(value) as count, avg(value) as mean, var_samp(value) as variance, min(value) as min, max(value) as max, stddev_samp(value) as std"


@query(
    "risk_and_statistics",
    f"""-- doubles: mean variance std min max q05 q50 q95 width90 probability expected_excess
    select row, col, {_STATS}, avg(((value - {BACKGROUND})::float >= 0.5::float)::double) as probability,
      avg(greatest(value - {BACKGROUND} - 0.5, 0)) as expected_excess, quantile_cont(value, 0.05) as q05,
      quantile_cont(value, 0.5) as q50, quantile_cont(value, 0.95) as q95,
      quantile_cont(value, 0.95) - quantile_cont(value, 0.05) as width90 from temperature group by row, col""",
    "temperature",
)
def risk_and_statistics(v):
    return C.risk_and_statistics(v.temperature, BACKGROUND, 0.5)


@query("field_statistics", f"-- doubles: mean variance std min max\nselect row, col, {_STATS} from fields_long group by row, col", "fields_long")
def field_statistics(v):
    return C.field_statistics(v.fields_long)


_EXCEED = f"""-- doubles: threshold probability
select threshold, row, col, avg(((value - {BACKGROUND})::float >= threshold::float)::double) as probability
from temperature, (select unnest([0.1, 0.5])::double as threshold) group by all"""


@query("exceedance_probability", _EXCEED, "temperature")
def exceedance_probability(v):
    return C.exceedance_probability(v.temperature, BACKGROUND, THRESHOLDS)


@query("risk_probability_map", _EXCEED.replace(">=", ">"), "temperature")
def risk_probability_map(v):
    return C.exceedance_probability(v.temperature, BACKGROUND, THRESHOLDS, ">")


@query(
    "expected_excess_map",
    f"""-- doubles: threshold expected_excess
    select threshold, row, col, avg(greatest(value - {BACKGROUND} - threshold, 0)) as expected_excess
    from temperature, (select unnest([0.1, 0.5])::double as threshold) group by all""",
    "temperature",
)
def expected_excess_map(v):
    return C.expected_excess(v.temperature, BACKGROUND, THRESHOLDS)


@query(
    "field_quantiles",
    """-- doubles: q05 q50 q95 width90
    select row, col, quantile_cont(value, 0.05) as q05, quantile_cont(value, 0.5) as q50, quantile_cont(value, 0.95) as q95,
      quantile_cont(value, 0.95) - quantile_cont(value, 0.05) as width90 from temperature group by row, col""",
    "temperature",
)
def field_quantiles(v):
    return C.field_quantiles(v.temperature)


@query(
    "log10k_field_statistics",
    """-- doubles: mean variance std min max
    select row, col, count(l) as count, avg(l) as mean, var_samp(l) as variance, min(l) as min, max(l) as max, stddev_samp(l) as std
    from (select row, col, log10(value) as l from permeability) group by row, col""",
    "permeability",
)
def log10k_field_statistics(v):
    return C.log10_statistics(v.permeability)


@query(
    "conditioning_residuals",
    """-- doubles: max_abs
    select f.sample_id, max(abs(f.value - r.value)) as max_abs from fields_long f join reference_field r
    on f.row = r.row and f.col = r.col and r.row = r.col group by f.sample_id""",
    "fields_long reference_field",
)
def conditioning_residuals(v):
    return C.conditioning_residuals(v.fields_long, v.reference_field.where("row = col").withColumnRenamed("value", "observed"))


@query(
    "budget_moments_field",
    "-- doubles: mean variance\nselect row, col, avg(value) as mean, var_samp(value) as variance from fields_long where sample_id < 128 group by row, col",
    "fields_long",
)
def budget_moments_field(v):
    return C.budget_moments(v.fields_long, 128)


@query(
    "design_mixture_variance",
    """-- doubles: "within" "between" mixture
    select row, col, avg(v) as "within", var_pop(m) as "between", avg(v) + var_pop(m) as mixture from (
      select sample_id % 4 as design, row, col, avg(value) as m, var_samp(value) as v from fields_long group by all) group by row, col""",
    "fields_long",
)
def design_mixture_variance(v):
    return C.design_mixture_variance(v.fields_long.withColumn("design", F.col("sample_id") % 4))


@query(
    "ensemble_bias_std_map",
    """-- doubles: bias std
    select f.row, f.col, avg(f.value - r.value) as bias, stddev_samp(f.value - r.value) as std
    from fields_long f join reference_field r on f.row = r.row and f.col = r.col group by f.row, f.col""",
    "fields_long reference_field",
)
def ensemble_bias_std_map(v):
    return C.bias_and_std(v.fields_long, v.reference_field.withColumnRenamed("value", "reference"))


@query(
    "ensemble_heldout_coverage",
    """-- doubles: coverage rmse mae
    select avg((r.value between lo and hi)::double) as coverage, sqrt(avg((m - r.value) * (m - r.value))) as rmse, avg(abs(m - r.value)) as mae
    from (select row, col, quantile_cont(value, 0.05) as lo, quantile_cont(value, 0.95) as hi, avg(value) as m
      from fields_long where sample_id > 0 group by row, col) c join reference_field r on c.row = r.row and c.col = r.col""",
    "fields_long reference_field",
)
def ensemble_heldout_coverage(v):
    return C.heldout_coverage(v.fields_long.where("sample_id > 0"), v.reference_field.withColumnRenamed("value", "truth"))


@query("guard_finite_positive", "select count(*) as rows, count(*) filter (k is null or not isfinite(k) or k <= 0) as violations from points", "points")
def guard_finite_positive(v):
    return G.violations(v.points, "k")


@query(
    "validate_output_grid",
    "select distinct row, col from (select floor(y_m / 1500)::int as row, floor(x_m / 1500)::int as col from points) where row not between 0 and 7 or col not between 0 and 7",
    "points",
)
def validate_output_grid(v):
    """Cells of points that a grid of 8 by 8 cells of 1500 m leaves out."""
    return G.outside_grid(v.points.select(*(F.floor(F.col(c) / 1500).cast("int").alias(n) for c, n in (("y_m", "row"), ("x_m", "col")))).distinct(), 8, 8)


@query("scan_cellid_reorder", "select count(*) as n, count(*) = count(distinct p_partkey) and min(p_partkey) = 1 and max(p_partkey) = count(*) as complete from part")
def scan_cellid_reorder(v):
    return G.permutation_check(v.table("part"), "p_partkey")


@query(
    "diagnostic_tee",
    "-- doubles: value\nselect sample_id, row, col, value from fields_long",
    "fields_long",
)
def diagnostic_tee(v):
    """Rows pass through unchanged; counts can be read from the observation."""
    return G.guarded(v.fields_long)


@query("scan_empirical_fields", "-- doubles: value\nselect sample_id, row, col, value from fields_long", "fields_long")
def scan_empirical_fields(v):
    return v.fields_long


@query("source_empirical_sampler", "-- doubles: value\nselect sample_id, row, col, log10(value) as value from permeability", "permeability")
def source_empirical_sampler(v):
    return G.guarded(v.permeability, positive=True).withColumn("value", F.log10("value"))


@query("limit_ordered_prefix", "-- doubles: value\nselect sample_id, row, col, value from permeability where sample_id < 100", "permeability")
def limit_ordered_prefix(v):
    """The first samples in their order, as many as a budget allows: the limit is the operator."""
    return v.permeability.where("sample_id < 100")
