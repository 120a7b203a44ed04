"""Queries of scalar functions, over customers, parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.functions import scalars as X
from gridweave.plans.registry import query

_LOG = "select sample_id, row, col, {} as y from permeability"


@query("log10_field", "-- doubles: y\n" + _LOG.format("log10(value)"), "permeability")
def log10_field(v):
    return v.permeability.select("sample_id", "row", "col", F.log10("value").alias("y"))


@query("pow10", "-- doubles: y\nselect sample_id, row, col, pow(10.0, value) as y from fields_long", "fields_long")
def pow10(v):
    return v.fields_long.select("sample_id", "row", "col", F.pow(F.lit(10.0), "value").alias("y"))


def _points(name: str, expression: str, column, more: str = "") -> None:
    """A query of one expression over the good points."""

    @query(name, f"-- doubles: y\nselect id, {expression} as y from good_points{more}", "good_points")
    def points(v):
        return v.good_points.select("id", column(F.col("k")).alias("y"))


_points("k_to_kh", "k * (999.7::double * 9.81::double / 0.0013::double) / 1e6", lambda k: X.k_to_kh(k) / 1e6)
_points("kh_to_k", "k / (999.7::double * 9.81::double / 0.0013::double) * 1e6", lambda k: X.kh_to_k(k) * 1e6)
_points("rescale", "(k - 0.1) / (2.0 - 0.1)", lambda k: X.rescale(k, 0.1, 2.0))
_points("standardize", "(k - 0.4) / 0.3", lambda k: X.standardize(k, 0.4, 0.3))
_points("log_rescale", "ln(k - 0.0 + 1) / ln(3.0)", lambda k: X.log_rescale(k, 0.0, 2.0))
_points("corr_exponential", "exp(-sqrt((x_m / 500) * (x_m / 500) + (y_m / 800) * (y_m / 800)))", lambda k: X.correlation("exponential", F.col("x_m"), F.col("y_m"), 500, 800))
_points("corr_radial_exponential", "exp(-sqrt((x_m / 900) * (x_m / 900) + (y_m / 900) * (y_m / 900)))", lambda k: X.correlation("exponential", F.col("x_m"), F.col("y_m"), 900, 900))
_points("corr_gaussian", "exp(-((x_m / 5000) * (x_m / 5000) + (y_m / 8000) * (y_m / 8000)) / 2)", lambda k: X.correlation("gaussian", F.col("x_m"), F.col("y_m"), 5000, 8000))
_points(
    "corr_matern32",
    "(1 + sqrt(3.0::double) * x_m / 5000) * exp(-sqrt(3.0::double) * x_m / 5000) * (1 + sqrt(3.0::double) * y_m / 8000) * exp(-sqrt(3.0::double) * y_m / 8000)",
    lambda k: X.correlation("matern32", F.col("x_m"), F.col("y_m"), 5000, 8000, separable=True),
)
_points("variogram_model", "0.2 + 0.8 * (1 - exp(-x_m / 3000))", lambda k: X.variogram(X.correlation("exponential", F.col("x_m"), F.lit(0.0), 3000, 3000), 0.2, 0.8))
_points("range_to_length_scale", "x_m / sqrt(2.0::double)", lambda k: X.range_to_length(F.col("x_m"), "gaussian"))
_points("arith_mean_correction", "-0.5 * ln(10.0::double) * k * k", lambda k: X.arithmetic_mean_shift(k))
_points("xi_to_offsets", "(2 * k - 1) * 500 + 500", lambda k: (2 * k - 1) * 500 + 500)
_points("unit_shift", "log10_k - log10(0.75::double)", lambda k: F.col("log10_k") - F.log10(F.lit(0.75)))
_points("projected_to_local", "x_m - 6400.0", lambda k: F.col("x_m") - 6400.0)
_points("interp_knots", "case when k <= 0.1 then -1 when k <= 0.4 then -1 + (k - 0.1) * (1.5 / 0.3) when k <= 0.9 then 0.5 + (k - 0.4) * (0.5 / 0.5) else 1 end", lambda k: X.interpolated(k, [(0.1, -1.0), (0.4, 0.5), (0.9, 1.0)]))


def _pairs(name: str, first: str, second: str, columns) -> None:
    @query(name, f"-- doubles: a b\nselect id, {first} as a, {second} as b from good_points", "good_points")
    def points(v):
        a, b = columns(F.col("k"))
        return v.good_points.select("id", a.alias("a"), b.alias("b"))


_pairs("lognormal_to_physical", "exp(log10_k + k * k / 2)", "exp(log10_k + k * k / 2) * sqrt(exp(k * k) - 1)", lambda k: X.lognormal_to_physical(F.col("log10_k"), k))
_pairs("physical_to_lognormal", "ln(k) - ln(1 + (0.2 / k) * (0.2 / k)) / 2", "sqrt(ln(1 + (0.2 / k) * (0.2 / k)))", lambda k: X.physical_to_lognormal(k, F.lit(0.2)))
_pairs("bounds_to_lognormal", "(ln(k) + ln(k + 1)) / 2", f"(ln(k + 1) - ln(k)) / (2 * {X.Z95})", lambda k: X.bounds_to_lognormal(k, k + 1))
_pairs("lognormal_to_bounds", f"exp(log10_k - {X.Z95} * k)", f"exp(log10_k + {X.Z95} * k)", lambda k: X.lognormal_to_bounds(F.col("log10_k"), k))


@query("georef_xy_to_index", "select id, round_even((x_m - 6.25) / 100, 0)::int as ix, round_even((y_m - 6.25) / 100, 0)::int as iy from points", "points")
def georef_xy_to_index(v):
    return v.points.select("id", X.nearest_index(F.col("x_m"), 6.25, 100.0).alias("ix"), X.nearest_index(F.col("y_m"), 6.25, 100.0).alias("iy"))


@query(
    "rotated_source_index",
    """select id, trunc((100 + x_m * cos(radians(120.0::double)) - y_m * sin(radians(120.0::double))) / 20)::bigint as i,
      trunc((200 + x_m * sin(radians(120.0::double)) + y_m * cos(radians(120.0::double))) / 20)::bigint as j from points""",
    "points",
)
def rotated_source_index(v):
    i, j = X.rotated_index(F.col("x_m"), F.col("y_m"), 30.0, 100.0, 200.0, 20.0)
    return v.points.select("id", i.alias("i"), j.alias("j"))


@query(
    "perlin_value_to_k",
    """-- doubles: y
    select sample_id, row, col, -11 + 2.5 * (value - min(value) over w) / (max(value) over w - min(value) over w) as y
    from fields_long window w as (partition by sample_id)""",
    "fields_long",
)
def perlin_value_to_k(v):
    from pyspark.sql import Window as W

    w = W.partitionBy("sample_id")
    low, high = F.min("value").over(w), F.max("value").over(w)
    return v.fields_long.select("sample_id", "row", "col", (-11 + 2.5 * (F.col("value") - low) / (high - low)).alias("y"))


for _name, _column in (("scenario_id", "concat(p_brand, ':', p_size)"), ("array_hash", "concat(p_name, p_type)"), ("sha256_file", "p_name")):

    @query(_name, f"select p_partkey, sha256({_column}) as h from part")
    def hashes(v, column=_column):
        return v.table("part").select("p_partkey", F.sha2(F.expr(column), 256).alias("h"))


@query("clean_text", r"select p_partkey, trim(regexp_replace(concat('  ', p_name, chr(9), ' ', p_type, ' '), '\s+', ' ', 'g')) as t from part")
def clean_text(v):
    return v.table("part").select("p_partkey", X.clean_text(F.concat(F.lit("  "), "p_name", F.lit("\t "), "p_type", F.lit(" "))).alias("t"))


@query("missing_identifier", "select n_nationkey, n_nationkey % 3 = 0 as missing from nation")
def missing_identifier(v):
    name = F.when(F.col("n_nationkey") % 3 == 0, " Fehlt ").otherwise(F.col("n_name"))
    return v.table("nation").select("n_nationkey", X.missing_identifier(name).alias("missing"))


_RUNS = "select concat(case when p_partkey % 5 = 0 then 'X_' else 'RUN_' end, p_partkey) as name from part"


@query("run_number", f"select name, case when regexp_matches(name, '^RUN_[0-9]+$') then substr(name, 5)::bigint end as run from ({_RUNS})")
def run_number(v):
    named = v.table("part").select(F.expr("concat(case when p_partkey % 5 = 0 then 'X_' else 'RUN_' end, p_partkey)").alias("name"))
    return named.select("name", X.run_number(F.col("name")).alias("run"))


@query("scan_discover_runs", f"select distinct substr(name, 5)::bigint as run from ({_RUNS}) where regexp_matches(name, '^RUN_[0-9]+$')")
def runs(v):
    named = v.table("part").select(F.expr("concat(case when p_partkey % 5 = 0 then 'X_' else 'RUN_' end, p_partkey)").alias("name"))
    return named.select(X.run_number(F.col("name")).alias("run")).where("run is not null").distinct().orderBy("run")


@query("json_safe", "-- doubles: y\nselect id, case when k > 0 then ln(k) end as y from points", "points")
def json_safe(v):
    raw = F.when(F.col("k") > 0, F.log("k")).otherwise(F.lit(float("nan")))
    return v.points.select("id", X.json_safe(raw).alias("y"))


@query("power_of_two", "select p_partkey, p_size > 0 and (p_size & (p_size - 1)) = 0 as yes from part")
def power_of_two(v):
    return v.table("part").select("p_partkey", X.power_of_two(F.col("p_size")).alias("yes"))


@query(
    "legendre_basis",
    """-- doubles: p0 p1 p2 p3
    select id, 1.0::double as p0, k * sqrt(3.0::double) as p1, (1.5 * k * k - 0.5) * sqrt(5.0::double) as p2, (2.5 * k * k * k - 1.5 * k) * sqrt(7.0::double) as p3 from points""",
    "points",
)
def legendre_basis(v):
    return v.points.select("id", *(X.legendre(F.col("k"), n).alias(f"p{n}") for n in range(4)))


@query(
    "hermite_basis",
    """-- doubles: h0 h1 h2 h3
    select id, 1.0::double as h0, k as h1, (k * k - 1) / sqrt(2.0::double) as h2, (k * k * k - 3 * k) / sqrt(6.0::double) as h3 from points""",
    "points",
)
def hermite_basis(v):
    return v.points.select("id", *(X.hermite(F.col("k"), n).alias(f"h{n}") for n in range(4)))
