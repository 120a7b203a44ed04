"""Queries of measurement ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.operators import measurements as M
from gridweave.plans.registry import query

_REASON = """case when k is null then 'non-numeric' when k <= 0 then 'non-positive' when stratum in ('MACHINERY') then 'stratigraphy'
  when state % 5 = 0 then 'groundwater' when x_m > 12000 then 'outside' end as reason"""


def _reasons(v):
    rules = [
        ("non-numeric", F.col("k").isNull()), ("non-positive", F.col("k") <= 0), ("stratigraphy", F.upper(F.trim("stratum")) == "MACHINERY"),
        ("groundwater", F.col("state") % 5 == 0), ("outside", F.col("x_m") > 12000),
    ]
    return M.with_reason(v.points, rules)


@query("scan_measurements_qc", f"select reason, count(*) as n from (select {_REASON} from points) group by reason", "points")
def scan_measurements_qc(v):
    return _reasons(v).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "scan_grid_footprint",
    """-- doubles: dx dy
    with xy as (select distinct x, y from xyz), dx as (select median(d) as dx, min(x) as x_min, max(x) as x_max from (select x, x - lag(x) over (order by x) as d from (select distinct x from xy))),
    dy as (select median(d) as dy, min(y) as y_min, max(y) as y_max from (select y, y - lag(y) over (order by y) as d from (select distinct y from xy)))
    select (select count(*) from xy) as active, x_min, y_min, dx, dy, (round_even((x_max - x_min) / dx, 0) + 1)::int as nx, (round_even((y_max - y_min) / dy, 0) + 1)::int as ny from dx, dy""",
    "xyz",
)
def scan_grid_footprint(v):
    return M.grid_footprint(v.xyz)


for _mode, _expr in (("zmode", "arg_max(k50, z)"), ("zmode_log_geomean", "pow(10.0, avg(log10(k50)))"), ("zmode_nearest", "arg_min(k50, struct_pack(a := abs(z - 3.2), z := z))")):

    @query(f"scan_surface_{_mode}", f"-- doubles: value\nselect x, y, {_expr} as value from xyz where k50 > 0 group by x, y", "xyz")
    def scan_surface(v, mode={"zmode": "top", "zmode_log_geomean": "log_geomean", "zmode_nearest": "nearest"}[_mode]):
        return M.surface(v.xyz, "k50", mode, 3.2)


@query(
    "scan_surface_sweep",
    "-- doubles: value\n"
    + " union all ".join(
        f"select x, y, '{c}' as \"column\", '{m}' as mode, {e.format(c)} as value from xyz where {c} > 0 group by x, y"
        for c in ("k10", "k50", "k90")
        for m, e in (("top", "arg_max({0}, z)"), ("bottom", "arg_min({0}, z)"), ("log_geomean", "pow(10.0, avg(log10({0})))"))
    ),
    "xyz",
)
def scan_surface_sweep(v):
    return M.surface_sweep(v.xyz, ["k10", "k50", "k90"])


@query(
    "cell_geometric_mean",
    """-- doubles: mean_log10 geometric_mean variance
    select floor(y_m / 800)::int as iy, floor(x_m / 800)::int as ix, count(*) as count, avg(log10_k) as mean_log10, pow(10.0, avg(log10_k)) as geometric_mean,
      coalesce(var_samp(log10_k), 0) as variance from good_points group by all""",
    "good_points",
)
def cell_geometric_mean(v):
    return M.cell_means(v.good_points, 800.0)


@query(
    "measurement_summary",
    """-- doubles: min mean max mean_log10 std_log10 q05 median q95
    select count(*) as n, min(k) as min, avg(k) as mean, max(k) as max, avg(log10_k) as mean_log10, stddev_samp(log10_k) as std_log10,
      count(distinct (floor(x_m / 800), floor(y_m / 800))) as cells, quantile_cont(k, 0.05) as q05, quantile_cont(k, 0.5) as median, quantile_cont(k, 0.95) as q95 from good_points""",
    "good_points",
)
def measurement_summary(v):
    return M.measurement_summary(v.good_points, 800.0)


@query("colocated_groups", "-- doubles: x_m y_m\nselect floor(x_m / 100) as x_m, floor(y_m / 100) as y_m, count(*) as count from points group by all having count(*) > 1", "points")
def colocated_groups(v):
    return M.colocated(v.points.select(F.floor(F.col("x_m") / 100).cast("double").alias("x_m"), F.floor(F.col("y_m") / 100).cast("double").alias("y_m")))


@query(
    "join_robustness_change",
    """-- doubles: score robust percent_change
    with a as (select p_brand as model, avg(p_retailprice) as score, median(p_retailprice) as robust from part group by p_brand)
    select model, score, robust, 100 * (robust - score) / score as percent_change from a""",
)
def join_robustness_change(v):
    part = v.table("part").withColumnRenamed("p_brand", "model")
    return M.robust_change(part.groupBy("model").agg(F.avg("p_retailprice").alias("score")), part.groupBy("model").agg(F.median("p_retailprice").alias("score")))


@query(
    "join_fit_to_cv",
    """-- doubles: fit cv
    select a.model, fit, cv from (select p_brand as model, avg(p_retailprice) as fit from part where p_size % 2 = 0 group by 1) a
    join (select p_brand as model, avg(p_retailprice) as cv from part where p_size % 2 = 1 group by 1) b on a.model = b.model""",
)
def join_fit_to_cv(v):
    part = v.table("part").withColumnRenamed("p_brand", "model")
    of = lambda k, name: part.where(F.col("p_size") % 2 == k).groupBy("model").agg(F.avg("p_retailprice").alias(name))
    return of(0, "fit").join(of(1, "cv"), "model")


@query(
    "scan_run_with_fallback",
    """-- doubles: value
    select coalesce(a.k, b.k) as run, coalesce(a.value, b.value) as value from (select s_suppkey as k, s_acctbal as value from supplier where s_suppkey % 3 = 0) a
    full join (select c_custkey as k, c_acctbal as value from customer) b on a.k = b.k""",
)
def scan_run_with_fallback(v):
    a = v.table("supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("run"), F.col("s_acctbal").alias("value"))
    b = v.table("customer").select(F.col("c_custkey").alias("run"), F.col("c_acctbal").alias("value"))
    return M.fallback(a, b, "run")


@query(
    "join_channel_stats",
    """-- doubles: value
    with s as (select label as channel, min(embedding[1]::double) as low, max(embedding[1]::double) as high from embeddings group by label)
    select vec_id, e.label as channel, (abs(embedding[2]::double)) * (high - low) + low as value from embeddings e join s on e.label = s.channel""",
)
def join_channel_stats(v):
    e, at = v.table("embeddings"), F.element_at("embedding", 1).cast("double")
    stats = e.groupBy(F.col("label").alias("channel")).agg(F.min(at).alias("low"), F.max(at).alias("high"))
    return M.channels_denormalized(e.select("vec_id", F.col("label").alias("channel"), F.abs(F.element_at("embedding", 2).cast("double")).alias("value")), stats).select("vec_id", "channel", "value")


_SPLIT = "case when i % 10 = 7 then 'validation' when i % 10 = 3 then 'test' else 'train' end"


@query("join_order_index_to_run", f"select i as position, run, {_SPLIT} as part from (select row_number() over (order by p_partkey) - 1 as i, p_partkey as run from part)")
def training_split(v):
    from pyspark.sql import Window as W

    runs = v.table("part").select(F.col("p_partkey").alias("run"), (F.row_number().over(W.orderBy("p_partkey")) - 1).cast("bigint").alias("position"))
    i = F.col("position")
    split = v.spark.range(v.table("part").count()).select(F.col("id").alias("position"), F.expr(_SPLIT.replace("i %", "id %")).alias("part"))
    return runs.join(split, "position").select(i, "run", "part")


_GEO = """rows as (select l_suppkey % 5 as run, case l_linenumber % 3 when 0 then 'k10' when 1 then 'k50' else 'k90' end as "column", case l_partkey % 2 when 0 then 'top' else 'bottom' end as z_mode,
  avg(l_discount) * 10 as correlation, avg(l_tax) as rmse, avg(l_quantity) > 25.3 as validated from lineitem group by all)"""


def _georef(v):
    keys = [(F.col("l_suppkey") % 5).alias("run"), F.expr("case l_linenumber % 3 when 0 then 'k10' when 1 then 'k50' else 'k90' end").alias("column"), F.expr("case l_partkey % 2 when 0 then 'top' else 'bottom' end").alias("z_mode")]
    return v.table("lineitem").groupBy(*keys).agg((F.avg("l_discount") * 10).alias("correlation"), F.avg("l_tax").alias("rmse"), (F.avg("l_quantity") > 25.3).alias("validated"))


_SWEEP = """-- doubles: mean_correlation min_correlation mean_rmse max_rmse
with rows as (select l_suppkey % 5 as run, case l_linenumber % 3 when 0 then 'k10' when 1 then 'k50' else 'k90' end as "column", case l_partkey % 2 when 0 then 'top' else 'bottom' end as z_mode,
  avg(l_discount) * 10 as correlation, avg(l_tax) as rmse, avg(l_quantity) > 25.3 as validated from lineitem group by all)
select "column", z_mode, count(*) = 5 as complete, bool_and(validated) as all_validated, avg(correlation) as mean_correlation, min(correlation) as min_correlation, avg(rmse) as mean_rmse, max(rmse) as max_rmse,
  rank() over (order by not bool_and(validated), round(avg(rmse), 9), "column", z_mode)::int as rank from rows group by "column", z_mode"""


@query("georef_sweep_summary", _SWEEP)
def georef_sweep_summary(v):
    from pyspark.sql import Window as W

    out = _georef(v).groupBy("column", "z_mode").agg(
        (F.count("*") == 5).alias("complete"), F.bool_and("validated").alias("all_validated"), F.avg("correlation").alias("mean_correlation"), F.min("correlation").alias("min_correlation"),
        F.avg("rmse").alias("mean_rmse"), F.max("rmse").alias("max_rmse"),
    )
    return out.withColumn("rank", F.rank().over(W.orderBy(~F.col("all_validated"), F.round("mean_rmse", 9), "column", "z_mode")))


@query(
    "join_representation_summary",
    f"""-- doubles: correlation mean_correlation
    with {_GEO} select run, "column", z_mode, correlation, avg(correlation) over (partition by "column", z_mode) as mean_correlation from rows""",
)
def join_representation_summary(v):
    rows = _georef(v)
    own = rows.groupBy("column", "z_mode").agg(F.avg("correlation").alias("mean_correlation"))
    return rows.join(F.broadcast(own), ["column", "z_mode"]).select("run", "column", "z_mode", "correlation", "mean_correlation")


@query(
    "rank_georef_per_run",
    f"""with {_GEO} select run, "column", z_mode, row_number() over (partition by run order by not validated, round(correlation, 9) desc, round(rmse, 9), "column", z_mode)::int as rank from rows""",
)
def rank_georef_per_run(v):
    from pyspark.sql import Window as W

    w = W.partitionBy("run").orderBy(~F.col("validated"), F.round("correlation", 9).desc(), F.round("rmse", 9), "column", "z_mode")
    return _georef(v).select("run", "column", "z_mode", F.row_number().over(w).alias("rank"))


@query(
    "join_metadata_georef",
    f"""-- doubles: gap
    with {_GEO}, m as (select s_suppkey as run, s_acctbal / 1e4 as angle from supplier where s_suppkey < 4)
    select r.run, c as convention, avg(abs(r.correlation - sign * m.angle)) as gap from rows r join m on r.run = m.run, (values ('same', 1), ('mirrored', -1), ('zero', 0)) t(c, sign) group by r.run, c""",
)
def join_metadata_georef(v):
    meta = v.table("supplier").where("s_suppkey < 4").select(F.col("s_suppkey").alias("run"), (F.col("s_acctbal") / 1e4).alias("angle"))
    each = _georef(v).join(meta, "run").select("run", "correlation", "angle", F.expr("stack(3, 'same', 1, 'mirrored', -1, 'zero', 0) as (convention, sign)"))
    return each.groupBy("run", "convention").agg(F.avg(F.abs(F.col("correlation") - F.col("sign") * F.col("angle"))).alias("gap"))


@query("unit_shift_interpretation", "select s_suppkey, case when abs(s_acctbal / 1e4 - 0.5) <= 0.1 then 'conductivity' when abs(s_acctbal / 1e4) <= 0.1 then 'same unit' else 'unexplained' end as meaning from supplier")
def unit_shift_interpretation(v):
    shift = F.col("s_acctbal") / 1e4
    meaning = F.when(F.abs(shift - 0.5) <= 0.1, "conductivity").when(F.abs(shift) <= 0.1, "same unit").otherwise("unexplained")
    return v.table("supplier").select("s_suppkey", meaning.alias("meaning"))
