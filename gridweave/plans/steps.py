"""Queries of single steps that composite operators are made of: joins, masks, partial statistics and rankings of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.operators import guards as G, regions as N, spatial as P, summaries as X
from gridweave.plans.registry import query
from gridweave.sources.views import BACKGROUND
from gridweave.streaming import accumulators as A

#: Samples in a batch of the accumulator queries.
BATCH = 32


@query("scan_prediction_field", "-- doubles: value\nselect sample_id, row, col, value from temperature where isfinite(value)", "temperature")
def scan_prediction_field(v):
    """Prediction fields with finite values only, on their grid; others are refused."""
    return G.guarded(v.temperature)


_RECEPTORS = [("receptor_001", 1, 1), ("receptor_002", 3, 4), ("receptor_003", 6, 2)]


@query(
    "receptor_select",
    "-- doubles: value\nselect r.name, t.sample_id, t.value from temperature t join (values " + ", ".join(map(str, _RECEPTORS)) + ") r(name, row, col) on t.row = r.row and t.col = r.col",
    "temperature",
)
def receptor_select(v):
    table = v.rows(_RECEPTORS, "name string, row int, col int")
    return v.temperature.join(F.broadcast(table), ["row", "col"]).select("name", "sample_id", "value")


@query("subset_mask", "-- doubles: x_m y_m k\nselect id, x_m, y_m, k, stratum from points where k > 0 and state % 2 = 0", "points")
def subset_mask(v):
    """One mask for all columns of a row."""
    return v.points.where((F.col("k") > 0) & (F.col("state") % 2 == 0)).select("id", "x_m", "y_m", "k", "stratum")


_OBSERVED = "row = col and row % 2 = 0"


@query("except_cells", f"select row, col from reference_field except all select row, col from reference_field where {_OBSERVED}", "reference_field")
def except_cells(v):
    cells = v.reference_field.select("row", "col")
    return cells.exceptAll(cells.where(_OBSERVED))


@query(
    "probe_exclude_observed",
    f"select row, col from reference_field where not ({_OBSERVED}) order by md5(concat(row, ':', col, ':11')), row, col limit 12",
    "reference_field",
)
def probe_exclude_observed(v):
    """A seeded draw of twelve probes among the cells that are not observed."""
    cells = v.reference_field.select("row", "col")
    free = cells.join(cells.where(_OBSERVED), ["row", "col"], "left_anti")
    seeded = F.md5(F.concat(F.col("row").cast("string"), F.lit(":"), F.col("col").cast("string"), F.lit(":11")))
    return free.orderBy(seeded, "row", "col").limit(12)


_RMSE = "select budget, target, sqrt(avg(error * error)) as rmse, count(*) as n from trial_errors where method = '%s' group by budget, target"


@query(
    "join_mc_rqmc_inner",
    f"-- doubles: rmse_mc rmse_rqmc\nselect budget, target, a.rmse as rmse_mc, b.rmse as rmse_rqmc, a.n as n_mc, b.n as n_rqmc from ({_RMSE % 'MC'}) a join ({_RMSE % 'RQMC'}) b using (budget, target)",
    "trial_errors",
)
def join_mc_rqmc_inner(v):
    """The groups of both methods; a group that one of them lacks is left out."""
    error = F.sqrt(F.avg(F.col("error") * F.col("error")))
    of = lambda m, s: v.trial_errors.where(F.col("method") == m).groupBy("budget", "target").agg(error.alias(f"rmse_{s}"), F.count("*").alias(f"n_{s}"))
    return of("MC", "mc").join(of("RQMC", "rqmc"), ["budget", "target"])


_CASES = "cases as (select year(l_shipdate)::varchar as profile, l_linenumber as budget, l_suppkey as trial, avg(l_discount) as value from lineitem group by all)"


@query(
    "join_paired_trials",
    f"-- doubles: value reference difference\nwith {_CASES} select a.budget, a.trial, a.profile, a.value, b.value as reference, a.value - b.value as difference from cases a join cases b on a.budget = b.budget and a.trial = b.trial and b.profile = '1995' where a.profile <> '1995'",
)
def join_paired_trials(v):
    """Each trial of a profile beside the same trial of the reference profile."""
    keys = [F.year("l_shipdate").cast("string").alias("profile"), F.col("l_linenumber").alias("budget"), F.col("l_suppkey").alias("trial")]
    cases = v.table("lineitem").groupBy(*keys).agg(F.avg("l_discount").alias("value"))
    reference = cases.where("profile = '1995'").select("budget", "trial", F.col("value").alias("reference"))
    return cases.where("profile <> '1995'").join(reference, ["budget", "trial"]).withColumn("difference", F.col("value") - F.col("reference"))


_COUNTS = "cases as (select l_linenumber as budget, (l_suppkey % 4)::int as n, var_samp(l_discount) as value from lineitem group by all)"


@query("join_prior_baseline", f"-- doubles: value prior\nwith {_COUNTS} select c.budget, c.n, c.value, p.value as prior from cases c left join cases p on c.budget = p.budget and p.n = 0 where c.n > 0")
def join_prior_baseline(v):
    """Each count of readings with the prior of its budget, null if there is none."""
    keys = [F.col("l_linenumber").alias("budget"), (F.col("l_suppkey") % 4).cast("int").alias("n")]
    cases = v.table("lineitem").groupBy(*keys).agg(F.var_samp("l_discount").alias("value"))
    prior = cases.where("n = 0").select("budget", F.col("value").alias("prior"))
    return cases.where("n > 0").join(prior, "budget", "left").select("budget", "n", "value", "prior")


@query(
    "join_prediction_reference",
    """-- doubles: prediction reference difference
    select p.sample_id, p.row - 1 as row, p.col - 1 as col, p.value as prediction, r.value as reference, p.value - r.value as difference
    from temperature p join (select row, col, value from temperature where sample_id = 0) r on p.row = r.row and p.col = r.col
    where p.sample_id > 0 and p.row between 1 and 6 and p.col between 1 and 6""",
    "temperature",
)
def join_prediction_reference(v):
    """Both fields cropped to their centre, cell beside cell, counted from the crop's corner."""
    cropped = P.crop_center(v.temperature, 8, 8, 6, 6)
    reference = cropped.where("sample_id = 0").select("row", "col", F.col("value").alias("reference"))
    both = cropped.where("sample_id > 0").withColumnRenamed("value", "prediction").join(F.broadcast(reference), ["row", "col"])
    return both.select("sample_id", "row", "col", "prediction", "reference", (F.col("prediction") - F.col("reference")).alias("difference"))


@query(
    "join_kriging_cross",
    """-- doubles: covariance
    select q.id, o.id as other, 0.16 * exp(-sqrt((q.x_m - o.x_m) * (q.x_m - o.x_m) + (q.y_m - o.y_m) * (q.y_m - o.y_m)) / 2000) as covariance
    from points q join good_points o on abs(q.x_m - o.x_m) <= 600 and abs(q.y_m - o.y_m) <= 600
    where (q.x_m - o.x_m) * (q.x_m - o.x_m) + (q.y_m - o.y_m) * (q.y_m - o.y_m) <= 360000""",
    "good_points",
    rounds=True,
)
def join_kriging_cross(v):
    """Covariances of query points and the observations within reach, met by places in blocks of that size."""
    return P.kriging_cross(v.points, v.good_points, 600.0, 0.16, 2000.0, digits=6)


@query("concat_fold_predictions", "-- doubles: truth mean std\nselect id, (block % 5)::int as fold, truth, mean, std from pred_truth", "pred_truth", digits=8)
def concat_fold_predictions(v):
    """Every fold's predictions in one table; repeated rows stay."""
    return v.pred_truth.select("id", (F.col("block") % 5).cast("int").alias("fold"), "truth", "mean", "std")


@query("run_inventory", "select run, row_number() over (order by run)::int as place from (select distinct (p_partkey % 97)::bigint as run from part)")
def run_inventory(v):
    """Each run once, in numeric order."""
    from pyspark.sql import Window as W

    runs = v.table("part").select((F.col("p_partkey") % 97).cast("bigint").alias("run")).distinct()
    return runs.withColumn("place", F.row_number().over(W.orderBy("run")))


@query(
    "training_split",
    """with t as (select p_partkey as run, case when p_size % 10 = 7 then 'validation' when p_size % 10 = 3 then 'test' else 'train' end as part from part)
    select part, count(*) as runs, min(run) as first, max(run) as last from t group by part""",
)
def training_split(v):
    """Runs by part, from a table of what each size's runs are for."""
    part = F.when(F.col("size") % 10 == 7, "validation").when(F.col("size") % 10 == 3, "test").otherwise("train")
    table = v.table("part").select(F.col("p_size").alias("size")).distinct().withColumn("part", part)
    runs = v.table("part").select(F.col("p_partkey").alias("run"), F.col("p_size").alias("size")).join(table, "size")
    return runs.groupBy("part").agg(F.count("*").alias("runs"), F.min("run").alias("first"), F.max("run").alias("last"))


_STATS = "count(*) as count, avg(value) as mean, var_samp(value) as variance, stddev_samp(value) as std, min(value) as min, max(value) as max"


def _batches(fields):
    """Partial rows of batches of samples, as the streaming accumulator writes them."""
    keyed = fields.withColumn("batch", F.floor(F.col("sample_id") / BATCH))
    return keyed.groupBy("batch", "row", "col").agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count("value")).alias("s"), F.min("value").alias("low"), F.max("value").alias("high")
    )


@query("field_statistics_accumulator", f"-- doubles: mean variance std min max\nselect row, col, {_STATS} from fields_long group by row, col", "fields_long")
def field_statistics_accumulator(v):
    """Statistics merged from batches, each of which was seen alone."""
    return A.merged(_batches(v.fields_long))


@query(
    "exceedance_accumulator",
    "-- doubles: probability\nselect row, col, count(*) filter (value::float >= 11.0::float) as hits, count(*) as n, avg((value::float >= 11.0::float)::double) as probability from temperature group by row, col",
    "temperature",
)
def exceedance_accumulator(v):
    """Counts of batches, added up."""
    hit = (F.col("value").cast("float") >= F.lit(11.0).cast("float")).cast("long")
    batch = F.floor(F.col("sample_id") / BATCH).alias("batch")
    counts = v.temperature.groupBy(batch, "row", "col").agg(F.sum(hit).alias("hits"), F.count("*").alias("n"))
    return counts.groupBy("row", "col").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("probability"))


@query(
    "qoi_warming_area",
    f"-- doubles: area_m2\nselect sample_id, count(*) filter ((value - {BACKGROUND})::float > 0.5::float) * 25.0 as area_m2 from temperature where row between 2 and 5 group by sample_id",
    "temperature",
)
def qoi_warming_area(v):
    """Area of a region's cells that are warmer than the threshold."""
    warm = (F.col("value") - BACKGROUND).cast("float") > F.lit(0.5).cast("float")
    return v.temperature.where("row between 2 and 5").groupBy("sample_id").agg((F.count_if(warm) * 25.0).alias("area_m2"))


@query(
    "risk_area",
    f"-- doubles: threshold area_m2\nselect sample_id, threshold, count(*) filter ((value - {BACKGROUND})::float > threshold::float) * 25.0 as area_m2 from temperature, (select unnest([0.1, 0.5, 1.0])::double as threshold) group by sample_id, threshold",
    "temperature",
)
def risk_area(v):
    """Exceeding area of each sample for several thresholds at once."""
    each = [F.struct(F.lit(t).alias("threshold"), (F.count_if((F.col("value") - BACKGROUND).cast("float") > F.lit(t).cast("float")) * 25.0).alias("area_m2")) for t in (0.1, 0.5, 1.0)]
    return v.temperature.groupBy("sample_id").agg(F.array(*each).alias("x")).select("sample_id", F.explode("x").alias("x")).select("sample_id", "x.*")


@query(
    "lag1_correlation",
    """-- doubles: correlation
    select sample_id, axis, coalesce(case when stddev_pop(a) > 1e-12 and stddev_pop(b) > 1e-12 then corr(a, b) end, 0) as correlation from (
      select sample_id, 'y' as axis, value as a, lag(value) over (partition by sample_id, col order by row) as b from fields_long
      union all select sample_id, 'x', value, lag(value) over (partition by sample_id, row order by col) from fields_long) where b is not null group by sample_id, axis""",
    "fields_long",
)
def lag1_correlation(v):
    """Pearson's correlation of neighbours along each axis; 0 for constant fields."""
    f, out = v.fields_long, None
    for axis, step in (("y", "row"), ("x", "col")):
        moved = f.select("sample_id", *(((F.col(c) + 1) if c == step else F.col(c)).cast("int").alias(c) for c in ("row", "col")), F.col("value").alias("b"))
        a = f.join(moved, ["sample_id", "row", "col"]).groupBy("sample_id")
        flat = (F.stddev_pop("value") > 1e-12) & (F.stddev_pop("b") > 1e-12)
        one = a.agg(F.coalesce(F.when(flat, F.corr("value", "b")), F.lit(0.0)).alias("correlation")).withColumn("axis", F.lit(axis))
        out = one if out is None else out.unionByName(one)
    return out


Z90 = 1.6448536269514722


@query(
    "posterior_validation",
    f"-- doubles: rmse mae coverage\nselect sqrt(avg((mean - truth) * (mean - truth))) as rmse, avg(abs(mean - truth)) as mae, avg((abs(truth - mean) <= {Z90} * std)::double) as coverage from pred_truth",
    "pred_truth",
)
def posterior_validation(v):
    e = F.col("mean") - F.col("truth")
    return v.pred_truth.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg((F.abs(e) <= Z90 * F.col("std")).cast("double")).alias("coverage"))


@query(
    "predictive_metrics_cv",
    f"""-- doubles: rmse mae coverage90 z_mean z_std nlpd
    select (block % 5)::int as fold, sqrt(avg((truth - mean) * (truth - mean))) as rmse, avg(abs(truth - mean)) as mae, avg((abs(truth - mean) <= {Z90} * std)::double) as coverage90,
      avg((truth - mean) / std) as z_mean, stddev_pop((truth - mean) / std) as z_std, avg(0.5 * ln(2 * pi() * std * std) + (truth - mean) * (truth - mean) / (2 * std * std)) as nlpd from pred_truth where std > 1e-12 group by fold""",
    "pred_truth",
)
def predictive_metrics_cv(v):
    """Scores of each fold; rows without spread are left out."""
    e, s = F.col("truth") - F.col("mean"), F.col("std")
    nlpd = 0.5 * F.log(2 * F.pi() * s * s) + e * e / (2 * s * s)
    return v.pred_truth.where("std > 1e-12").groupBy((F.col("block") % 5).cast("int").alias("fold")).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg((F.abs(e) <= Z90 * s).cast("double")).alias("coverage90"), F.avg(e / s).alias("z_mean"), F.stddev_pop(e / s).alias("z_std"), F.avg(nlpd).alias("nlpd")
    )


@query(
    "rank_in_ensemble",
    "select trial, count(*) filter (value < truth) as below, count(*) filter (value = truth) as equal, count(*) as draws from draws group by trial",
    "draws",
)
def rank_in_ensemble(v):
    """How many draws of a trial lie below the truth, and how many are equal to it."""
    x, t = F.col("value"), F.col("truth")
    return v.draws.groupBy("trial").agg(F.count_if(x < t).alias("below"), F.count_if(x == t).alias("equal"), F.count("*").alias("draws"))


@query(
    "rank_screen",
    """-- doubles: score
    with m as (select p_type as family, count(distinct p_brand) as brands, round(avg(p_retailprice), 6) as score from part group by p_type), most as (select max(brands) as brands from m)
    select family, score, row_number() over (order by score, family)::int as rank from m join most using (brands)""",
)
def rank_screen(v):
    """Families with complete coverage only, by their mean score."""
    from pyspark.sql import Window as W

    m = v.table("part").groupBy(F.col("p_type").alias("family")).agg(F.count_distinct("p_brand").alias("brands"), F.round(F.avg("p_retailprice"), 6).alias("score"))
    whole = m.join(F.broadcast(m.agg(F.max("brands").alias("brands"))), "brands")
    return whole.select("family", "score", F.row_number().over(W.orderBy("score", "family")).alias("rank"))


@query(
    "rank_fit_windows",
    "select p_brand, p_type, p_partkey from (select *, row_number() over (partition by p_brand, p_type order by p_size, p_retailprice, p_name, p_partkey) as rank from part) where rank = 1",
)
def rank_fit_windows(v):
    """The first of each run and family by four keys, as an aggregate."""
    best = F.min(F.struct("p_size", "p_retailprice", "p_name", "p_partkey")).alias("x")
    return v.table("part").groupBy("p_brand", "p_type").agg(best).select("p_brand", "p_type", "x.p_partkey")


@query("lhs_select", "select t.place::int as place, p.p_partkey, p.p_size from part p join (select unnest([5, 1, 64, 17]) as place) t on p.p_partkey = t.place")
def lhs_select(v):
    """Rows of a design by their 1-based places."""
    places = v.rows([(5,), (1,), (64,), (17,)], "place int")
    return v.table("part").join(F.broadcast(places), F.col("p_partkey") == F.col("place")).select("place", "p_partkey", "p_size")


@query(
    "convergence_rows",
    """-- doubles: value
    with q as (select sample_id, avg(value) as value from temperature group by sample_id), s as (select budget, avg(value) as mean, stddev_samp(value) as sd from q, budgets where sample_id < budget group by budget),
    f as (select budget, avg(m) as mean, avg(v) as variance from (select budget, row, col, avg(value) as m, var_samp(value) as v from temperature, budgets where sample_id < budget group by all) group by budget)
    select 'scalar' as target, budget, 'mean' as metric, mean as value from s union all select 'scalar', budget, 'sd', sd from s
    union all select 'global', budget, 'mean', mean from f union all select 'global', budget, 'variance', variance from f""",
    "temperature budgets",
)
def convergence_rows(v):
    """Tidy rows of a scalar and of the whole field, by budget."""
    q = v.temperature.groupBy("sample_id").agg(F.avg("value").alias("value"))
    s = X.prefix_fields(q, v.budgets).groupBy("budget").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    cells = X.prefix_fields(v.temperature, v.budgets).groupBy("budget", "row", "col").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    f = cells.groupBy("budget").agg(F.avg("m").alias("mean"), F.avg("v").alias("variance"))
    long = lambda df, name: df.unpivot(["budget"], [c for c in df.columns if c != "budget"], "metric", "value").withColumn("target", F.lit(name))
    return long(s, "scalar").unionByName(long(f, "global")).select("target", "budget", "metric", "value")


@query(
    "callable_surrogate",
    "-- doubles: value\nselect sample_id, row, col, 10.6 + 4 * exp(log10(value) + 9.3) as value from permeability",
    "permeability",
)
def callable_surrogate(v):
    """A surrogate given as a function of a column, applied to each field."""
    surrogate = lambda k: 10.6 + 4 * F.exp(F.log10(k) + 9.3)
    return v.permeability.withColumn("value", surrogate(F.col("value")))


@query(
    "heat_pump_centers",
    """-- doubles: y x
    with recursive m as (select sample_id, row, col, row * 8 + col as cell from fields_long where (case when value >= 0.1 then 2 else 1 end) = 2),
    r as (select sample_id, cell, cell as root from m union select r.sample_id, n.cell, r.root from r join m c on c.sample_id = r.sample_id and c.cell = r.cell
      join m n on n.sample_id = c.sample_id and abs(n.row - c.row) + abs(n.col - c.col) = 1),
    l as (select sample_id, cell, min(root) as label from r group by sample_id, cell)
    select m.sample_id, avg(m.row) as y, avg(m.col) as x, count(*) as cells from m join l on l.sample_id = m.sample_id and l.cell = m.cell group by m.sample_id, label""",
    "fields_long",
)
def heat_pump_centers(v):
    """Centroid of each connected region of the second material, which fields have from a value up; regions go on over tiles."""
    material = F.when(F.col("value") >= 0.1, 2).otherwise(1)
    return N.centres(v.fields_long.where(material == 2), tile=4)


@query(
    "normal_score_diagnostics",
    "-- doubles: mean std skewness\nselect avg(z) as mean, stddev_pop(z) as std, avg(z * z * z) as skewness, count(*) filter (abs(z) >= 2) as tails, count(*) as n from (select (value + 9.3) / 0.125 as z from log_k)",
    "log_k",
)
def normal_score_diagnostics(v):
    """Moments of scores and how many lie in the tails."""
    z = (F.col("value") + 9.3) / 0.125
    return v.log_k.agg(F.avg(z).alias("mean"), F.stddev_pop(z).alias("std"), F.avg(z * z * z).alias("skewness"), F.count_if(F.abs(z) >= 2).alias("tails"), F.count("*").alias("n"))


_TRAIN = "f as (select sample_id, sample_id % 2 as half, avg(value) as mean, stddev_samp(value) as std, min(value) as low, max(value) as high from fields_long group by sample_id), l as (unpivot f on mean, std, low, high into name metric value x)"
_METRICS = ["mean", "std", "low", "high"]


def _fields(v):
    """sample_id, half, metric, x: descriptors of each field; odd samples are training fields, even ones generated."""
    f = v.fields_long.groupBy("sample_id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))
    return f.withColumn("half", F.col("sample_id") % 2).unpivot(["sample_id", "half"], _METRICS, "metric", "x")


@query("training_profile", f"-- doubles: mean std q05 q95\nwith {_TRAIN} select metric, count(*) as n, avg(x) as mean, stddev_samp(x) as std, quantile_cont(x, 0.05) as q05, quantile_cont(x, 0.95) as q95 from l where half = 1 group by metric", "fields_long")
def training_profile(v):
    """How the descriptors of training fields are distributed."""
    q = F.percentile("x", F.array(F.lit(0.05), F.lit(0.95))).alias("q")
    p = _fields(v).where("half = 1").groupBy("metric").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), q)
    return p.select("metric", "n", "mean", "std", F.col("q")[0].alias("q05"), F.col("q")[1].alias("q95"))


_PATCH = "p as (select sample_id, sample_id % 2 as half, (row // 4 * 2 + col // 4)::int as patch, avg(value) as mean from fields_long group by all)"


@query(
    "patch_compat",
    f"""-- doubles: low high outside
    with {_PATCH}, r as (select patch, min(mean) as low, max(mean) as high from p where half = 1 group by patch)
    select p.patch, low, high, avg((p.mean < low or p.mean > high)::int::double) as outside from p join r on p.patch = r.patch where half = 0 group by all""",
    "fields_long",
)
def patch_compat(v):
    """Of each patch the range of training means, and the share of generated ones outside it."""
    patch = F.expr("int(row div 4 * 2 + col div 4)").alias("patch")
    p = v.fields_long.groupBy("sample_id", patch).agg(F.avg("value").alias("mean")).withColumn("half", F.col("sample_id") % 2)
    r = p.where("half = 1").groupBy("patch").agg(F.min("mean").alias("low"), F.max("mean").alias("high"))
    out = ((F.col("mean") < F.col("low")) | (F.col("mean") > F.col("high"))).cast("double")
    return p.where("half = 0").join(F.broadcast(r), "patch").groupBy("patch", "low", "high").agg(F.avg(out).alias("outside"))


@query(
    "reference_comparison",
    """-- doubles: mean_error std_error mean_bias
    with c as (select row, col, avg(value) filter (sample_id % 2 = 0) as m0, avg(value) filter (sample_id % 2 = 1) as m1, stddev_samp(value) filter (sample_id % 2 = 0) as s0, stddev_samp(value) filter (sample_id % 2 = 1) as s1 from fields_long group by row, col)
    select sqrt(sum((m0 - m1) * (m0 - m1)) / sum(m1 * m1)) as mean_error, sqrt(sum((s0 - s1) * (s0 - s1)) / sum(s1 * s1)) as std_error, avg(m0 - m1) as mean_bias from c""",
    "fields_long",
)
def reference_comparison(v):
    """Maps of mean and spread of an ensemble against those of a reference ensemble: relative L2 errors."""
    even, value = F.col("sample_id") % 2 == 0, F.col("value")
    cells = v.fields_long.groupBy("row", "col").agg(
        F.avg(F.when(even, value)).alias("m0"), F.avg(F.when(~even, value)).alias("m1"), F.stddev_samp(F.when(even, value)).alias("s0"), F.stddev_samp(F.when(~even, value)).alias("s1")
    )
    error = lambda k: F.sqrt(F.sum((F.col(f"{k}0") - F.col(f"{k}1")) ** 2) / F.sum(F.col(f"{k}1") ** 2))
    return cells.agg(error("m").alias("mean_error"), error("s").alias("std_error"), F.avg(F.col("m0") - F.col("m1")).alias("mean_bias"))


@query(
    "normal_score_local_std",
    "-- doubles: std\nselect sample_id, row, col, 0.1::double * case when z <= -2 then 0 when z <= -0.8 then 1 / 6.0 when z <= 0.8 then 1 / 8.0 when z <= 2 then 1 / 6.0 else 0 end as std from (select sample_id, row, col, 8 * value as z from fields_long)",
    "fields_long",
)
def normal_score_local_std(v):
    """The spread of a value whose score has a spread of 0.1: that times the slope of the map where the score lies."""
    z = 8 * F.col("value")
    slope = F.when(z <= -2, 0.0).when(z <= -0.8, 1 / 6).when(z <= 0.8, 1 / 8).when(z <= 2, 1 / 6).otherwise(0.0)
    return v.fields_long.select("sample_id", "row", "col", (0.1 * slope).alias("std"))
