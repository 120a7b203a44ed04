"""Queries of samplers, random fields, kriging, fits and special functions; no SQL can check them value by value."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.functions import special as Z
from gridweave.operators import fitting as X, likelihood as L, selection as S, spatial as P
from gridweave.plans.registry import query
from gridweave.randomfield import coordinates as C, fields as R

SEED = 11


def _arrays(v):
    return v.table("embeddings").select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("values"))


def _points(v):
    return v.good_points.select("id", "x_m", "y_m", F.col("log10_k").alias("value"))


def designs(v):
    """Ids of the designs to be drawn: those of the ensemble's samples."""
    return v.table("embeddings").select(F.col("vec_id").alias("id"))


query("gaussian_sampler")(lambda v: C.iid_gaussian(v.spark, designs(v), 8, SEED))
query("iid_gaussian")(lambda v: C.iid_gaussian(v.spark, designs(v), 3, SEED))
query("uniform_sampler")(lambda v: C.iid_uniform(v.spark, designs(v), 8, SEED))
query("iid_uniform")(lambda v: C.iid_uniform(v.spark, designs(v), 3, SEED))
query("sobol_sampler")(lambda v: C.sobol(v.spark, designs(v), 6, SEED))
query("lhs_uniform")(lambda v: C.latin_hypercube(v.spark, designs(v), 4, SEED))
query("lhs_gaussian")(lambda v: C.latin_hypercube(v.spark, designs(v), 4, SEED, gaussian=True))


def _expansion(v):
    """An expansion with the ensemble's own mean and spread."""
    mean, sigma = v.log_k.agg(F.avg("value"), F.stddev_pop("value")).first()
    return R.Expansion.fit(8, 8, mean or 0.0, sigma or 1.0, 4.0)


def coordinates(v):
    """sample_id, xi: the samples' 64 numbers, about standard normal, as coordinates of fields."""
    return v.table("embeddings").select(F.col("vec_id").alias("sample_id"), F.transform("embedding", lambda x: 8 * x.cast("double")).alias("xi"))


def _unit(v):
    """sample_id, values: the samples' fields, about standard normal."""
    return coordinates(v).withColumnRenamed("xi", "values")


@query("kl_map")
def kl_map(v):
    return R.to_long(_expansion(v).map(coordinates(v)), 8)


@query("kl_conditional")
def kl_conditional(v, noise=0.05):
    """Fields of the coordinates, given the permeability of sample 0 at the cells that have wells."""
    wells = v.points.select(F.floor(F.col("y_m") / 1600).cast("int").alias("row"), F.floor(F.col("x_m") / 1600).cast("int").alias("col")).distinct()
    known = wells.join(v.log_k.where("sample_id = 0"), ["row", "col"]).orderBy("row", "col").collect()
    return R.to_long(_expansion(v).map_conditioned(coordinates(v), [8 * r["row"] + r["col"] for r in known], [r["value"] for r in known], noise), 8)


@query("fft_residual")
def fft_residual(v):
    return R.to_long(R.fft_fields(v.spark, designs(v), 16, 16, 0.3, 3.0, SEED), 16)


def _grid_kriging(v):
    """A system of the first well of each row of cells."""
    cell = [F.floor(F.col(c) / 1600).cast("int").alias(n) for c, n in (("x_m", "col"), ("y_m", "row"))]
    first = v.good_points.select("id", "log10_k", *cell).groupBy("row").agg(F.min_by(F.struct("col", "log10_k"), "id").alias("w")).orderBy("row").collect()
    return R.Kriging.fit([(r["w"]["col"], r["row"]) for r in first], [0.3 * (r["w"]["log10_k"] + 0.4) for r in first], 0.3, 3.0, mean=0.0)


@query("conditional_fft")
def conditional_fft(v):
    return R.to_long(_grid_kriging(v).update(R.fft_fields(v.spark, designs(v), 8, 8, 0.3, 3.0, SEED), 8), 8)


@query("cached_prior")
def cached_prior(v):
    """A free field for each design, from its id alone: the same whenever it is drawn again."""
    return R.fft_fields(v.spark, designs(v), 8, 8, 0.3, 3.0, SEED)


@query("reference_field_map")
def reference_field_map(v):
    """The reference field times 10 to the residuals of all draws."""
    base = [r["value"] - 9.3 for r in v.reference_field.orderBy("row", "col").collect()]
    return R.to_long(R.around_reference(R.fft_fields(v.spark, designs(v), 8, 8, 0.3, 3.0, SEED), base, 0.3, arithmetic=True), 8)


@query("normal_score_map")
def normal_score_map(v):
    """Gaussian scores through a map whose knots are the ensemble's own quantiles."""
    from gridweave.functions.scalars import interpolated
    from gridweave.functions.special import ppf
    import numpy as np

    p = [0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98]
    knots = v.log_k.agg(F.percentile("value", F.array(*map(F.lit, p)))).first()[0]
    return R.to_long(_unit(v), 8).withColumn("value", interpolated(F.col("value"), list(zip(ppf(np.array(p)).tolist(), knots or p))))


@query("perlin_field")
def perlin_field(v):
    return R.to_long(R.perlin(v.spark, designs(v), 16, 16, 5.0, SEED), 16)


@query("ordinary_kriging")
def ordinary_kriging(v):
    return X.local_kriging(v.points, _points(v), 0.4, 2000.0, nugget=0.05)


@query("simple_kriging_points")
def simple_kriging_points(v):
    return X.local_kriging(v.points, _points(v), 0.4, 2000.0, mean=-0.4, nugget=0.05)


query("spectrum_2d")(lambda v: R.spectrum(_arrays(v), 8, 8))


query("connected_components")(lambda v: R.components(_arrays(v), 8, 8, 0.1))


@query("streamlines")
def streamlines(v):
    """Faded rasters of the lines from each field's highest cell, in three passes: from there and from both sides."""
    from gridweave.operators import streamlines as T

    top = v.fields_long.groupBy("sample_id").agg(F.max_by(F.struct("row", "col"), F.struct("value", "row", "col")).alias("c"))
    starts = top.select("sample_id", F.lit(0).alias("line"), F.col("c.row").alias("row"), F.col("c.col").alias("col"))
    return T.rasters(T.lines(_arrays(v), starts, 8, 8, (0.0, 1.0, -1.0), speed=4.0))


query("normal_cdf")(lambda v: v.points.select("id", Z.normal_cdf("k").alias("p")))
query("normal_ppf")(lambda v: v.points.select("id", Z.normal_ppf(F.col("x_m") / 12800 * 0.98 + 0.01).alias("z")))
query("gaussian_crps")(lambda v: v.pred_truth.select("id", Z.gaussian_crps("mean", "std", "truth").alias("crps")))


@query("clopper_pearson")
def clopper_pearson(v):
    counts = v.points.groupBy("stratum").agg(F.count_if(F.col("k") > 0.5).alias("k"), F.count("*").alias("n"))
    return counts.select("stratum", "k", "n", Z.clopper_pearson_interval("k", "n").alias("ci")).select("stratum", "k", "n", "ci.lower", "ci.upper")


@query("normal_score_qq")
def normal_score_qq(v):
    """The values of every cell beside the normal scores of their ranks.

    Ranks are within a cell. Stretches are of equal numbers, not of equal
    width: each cell's approximate quantiles cut its values, what stands
    before a stretch is a count, and a window runs within a stretch.
    """
    from pyspark.sql import Window as W

    fields, cell = v.log_k, ["row", "col"]
    cuts = fields.groupBy(*cell).agg(F.percentile_approx("value", F.array(*(F.lit(k / 16) for k in range(1, 16))), 1000).alias("cuts"), F.count("*").alias("n"))
    placed = fields.join(cuts, cell).withColumn("stretch", F.size(F.filter("cuts", lambda c: c < F.col("value"))))
    counts = placed.groupBy(*cell, "stretch").agg(F.count("*").alias("m"))
    before = counts.select(*cell, "stretch", F.coalesce(F.sum("m").over(W.partitionBy(*cell).orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.col("before") + F.row_number().over(W.partitionBy(*cell, "stretch").orderBy("value"))
    ranked = placed.join(before, [*cell, "stretch"]).select(*cell, "value", ((rank - 0.5) / F.col("n")).alias("p"))
    return ranked.select(*cell, "value", Z.normal_ppf("p").alias("z"))


@query("fold_assign_greedy")
def fold_assign_greedy(v):
    return S.balanced_folds(v.points, 1500.0, 5, SEED).select("id", "bx", "by", "fold")


query("spatial_partition")(lambda v: S.spatial_partition(v.points.select("id", "x_m", "y_m"), 1500.0, 0.2, 300.0, SEED).select("id", "part"))
query("grid_test_partition")(lambda v: S.grid_partition(v.reference_field.select("row", "col"), 2, 0.2, 1, 8, 8, SEED))


def _places(v):
    return v.points.select("id", "x_m", "y_m", "k")


query("sample_boreholes")(lambda v: S.boreholes(_places(v), 8, 500.0, 900.0, SEED))
query("coverage_locations")(lambda v: S.farthest_points(_places(v), 8))
query("covariance_locations")(lambda v: S.variance_locations(_places(v), 8, 0.4, 2000.0, SEED))
query("draw_reference_measurements")(lambda v: S.weighted_locations(_places(v), F.col("k"), 8, 900.0, 0.2, SEED))


@query("variogram_fit_points")
def variogram_fit_points(v):
    curve = P.point_variogram(_points(v), 1200.0, 150.0)
    return X.variogram_fits(curve.select("direction", F.col("mean_lag").alias("lag"), "gamma", "pairs"), "direction")


@query("variogram_fit_grid")
def variogram_fit_grid(v):
    curve = P.directional_variograms(v.fields_long, {"y": (1, 0), "x": (0, 1), "diagonal": (1, 1)}, [1, 2, 3, 4, 5])
    return X.variogram_fits(curve.select("direction", F.col("distance").alias("lag"), "gamma", "pairs"), "direction")


@query("spatial_block_cv")
def spatial_block_cv(v):
    folded = S.balanced_folds(_points(v), 1500.0, 5, SEED)
    return X.local_cross_validation(folded.select("id", "x_m", "y_m", "value", "fold"), 5, 0.4, 1500.0, 0.05)


def _model(name, sigma, length, nugget, family="exponential", trend="constant"):
    return {"model": name, "sigma": sigma, "length": length, "nugget": nugget, "family": family, "trend": trend}


@query("universal_kriging_predict")
def universal_kriging_predict(v):
    """A linear trend, estimated with the field; the variance holds its uncertainty."""
    return X.local_kriging(v.points, _points(v), models=[_model("linear", 0.4, 2000.0, 0.05, trend="linear")]).select("id", "mean", "variance")


def development(v):
    """Fits and predictions of four models, refitted in buffered folds."""
    models = [{"model": f"{f}/{t}", "family": f, "trend": t} for f in ("exponential", "matern32") for t in ("constant", "linear")]
    return L.refitted_folds(S.balanced_folds(_points(v), 1500.0, 5, SEED), 5, models, 1500.0, 300.0)


@query("development_cv")
def development_cv(v):
    """Each model's fit, or its error, and scores in each buffered fold; the choice goes by equal blocks among models without a failure."""
    fits, found = development(v)
    e, crps = F.col("mean") - F.col("truth"), Z.gaussian_crps("mean", "std", "truth").alias("crps")
    return L.scored_folds(fits, found.select("model", "fold", "block", e.alias("e"), crps))


@query("select_covariance")
def select_covariance(v):
    """Candidates by the continuous ranked probability score, each block with the same weight; the best has rank 1."""
    from pyspark.sql import Window as W

    models = [_model(f"{s}/{length:g}", s, length, 0.05) for s in (0.3, 0.5) for length in (500.0, 1500.0, 4000.0)]
    found = X.model_cross_validation(S.balanced_folds(_points(v), 1500.0, 5, SEED), 5, models, 1500.0)
    blocks = found.groupBy("model", "block").agg(F.avg(Z.gaussian_crps("mean", "std", "truth")).alias("crps"))
    scores = blocks.groupBy("model").agg(F.avg("crps").alias("crps"), F.count("*").alias("blocks"))
    return scores.withColumn("rank", F.row_number().over(W.orderBy("crps", "model")))


query("reml_fit")(lambda v: L.reml(_points(v)))


@query("structural_profile_fit")
def structural_profile_fit(v):
    """A rotated anisotropic model of the fields' variograms in four directions."""
    ways = {"y": (1, 0), "x": (0, 1), "diagonal": (1, 1), "other": (1, -1)}
    curve = P.directional_variograms(v.fields_long, ways, [1, 2, 3, 4, 5])
    unit = lambda k: F.create_map(*(F.lit(x) for n, w in ways.items() for x in (n, w[k] / (w[0] ** 2 + w[1] ** 2) ** 0.5)))[F.col("direction")]
    lags = curve.select((unit(0) * F.col("distance")).alias("dy"), (unit(1) * F.col("distance")).alias("dx"), "gamma", "pairs")
    return X.structural_fit(lags, v.fields_long.agg(F.var_pop("value")).first()[0], 8, 8)


@query("block_bootstrap")
def block_bootstrap(v):
    blocks = v.pred_truth.groupBy("block").agg(F.avg(F.col("truth") - F.col("mean")).alias("value"))
    return X.block_bootstrap(blocks, 500, SEED)


@query("condition_number")
def condition_number(v):
    return X.block_condition(v.good_points, 2000.0)


@query("pce_workflow")
def pce_workflow(v):
    """Train a response of two coordinates on one half of the lines, validate on the other: both coordinates come from the table."""
    from gridweave.functions.scalars import legendre
    from gridweave.operators import distributions as D, scoring

    a, b = F.col("l_discount") / 0.05 - 1, F.col("l_tax") / 0.04 - 1
    lines = v.table("lineitem").select("l_orderkey", a.alias("a"), b.alias("b"), F.log("l_extendedprice").alias("price"))
    lines = lines.withColumn("y", F.col("price") * (1 + 0.3 * F.col("a")) + 0.5 * F.col("a") * F.col("b"))
    terms = [(i, j) for i in range(3) for j in range(3 - i)]
    basis = [legendre(F.col("a"), i) * legendre(F.col("b"), j) for i, j in terms]
    found = D.solve_normal(D.normal_equations(lines.where("l_orderkey % 2 = 0"), basis, F.col("y")))
    check = lines.where("l_orderkey % 2 = 1").select(D.predicted(basis, found).alias("prediction"), F.col("y").alias("reference"))
    return scoring.response_diagnostics(check)
