"""Composite studies: several operators over shared ensembles, as one long table each.

A study returns rows (part, key, value), so its parts can be read and
checked together. What several parts use is one DataFrame; Spark reuses the
exchange where parts group it the same way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gridweave.operators import cells as C, distributions as D, measurements as M, samples as S, scoring as X, spatial as P, summaries as Y
from gridweave.plans.registry import query
from gridweave.sources.views import BACKGROUND, rounded


def parts(**tables: DataFrame) -> DataFrame:
    """Each table's doubles by its other columns, in one long table."""
    out = []
    for name, df in tables.items():
        values = [c for c, t in df.dtypes if t == "double"]
        keys = [c for c in df.columns if c not in values]
        key = F.concat_ws("/", *(F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys)) if keys else F.lit("")
        long = df.select(key.alias("key"), *values).unpivot(["key"], values, "statistic", "value")
        out.append(long.select(F.lit(name).alias("part"), F.concat_ws("/", F.when(F.col("key") != "", F.col("key")), "statistic").alias("key"), "value"))
    return reduce(DataFrame.unionByName, out)


def _qoi(v) -> DataFrame:
    return S.mean_anomaly(v.temperature, BACKGROUND).withColumnRenamed("mean_anomaly", "value")


@query("rq1")
def rq1(v):
    """An ensemble's propagation: cell statistics, risk, quantities of interest, convergence, method gain and repeated designs of all variants."""
    from gridweave.plans.sequences import rq1_repeated

    return parts(
        repeated=rq1_repeated(v).drop("repetitions"),
        cells=C.risk_and_statistics(v.temperature, BACKGROUND, 0.5), uncertainty=Y.global_uncertainty(C.field_statistics(v.temperature)), qoi=Y.scalar_summary(_qoi(v)),
        fields=Y.prefix_field_convergence(v.temperature, v.budgets), scalars=Y.scalar_prefix_convergence(_qoi(v), v.budgets), gain=Y.method_gain(v.trial_errors).drop("repetitions"),
    )


@query("controlled_benchmark")
def controlled_benchmark(v):
    """Draws against truth: scores, calibration and reduction of the spread."""
    scores = X.ensemble_scores(v.draws)
    return parts(scores=scores.withColumn("truth", F.col("truth").cast("string")), calibration=X.calibration(scores, 5, 0.9), risk=Y.tail_risk(_qoi(v), 0.9))


def _profiles(v) -> DataFrame:
    keys = [F.year("l_shipdate").cast("string").alias("profile"), F.col("l_linenumber").alias("budget"), F.col("l_suppkey").alias("trial")]
    return v.table("lineitem").groupBy(*keys).agg(F.avg("l_discount").alias("value"))


@query("profile_sensitivity")
def profile_sensitivity(v):
    rows = _profiles(v)
    return parts(contrast=Y.paired_contrast(rows, "1995"), level=Y.mean_sem(rows, ("budget", "profile")))


@query("measurement_density")
def measurement_density(v):
    """Variance by number of readings, its reduction from the prior, and moments by prefix."""
    keys = [F.col("l_linenumber").alias("budget"), (F.col("l_suppkey") % 4).cast("int").alias("n")]
    cases = v.table("lineitem").groupBy(*keys).agg(F.var_samp("l_discount").alias("value"))
    return parts(reduction=Y.reduction_from_prior(cases), prior=C.budget_moments(v.fields_long, 32), final=C.budget_moments(v.fields_long, 256))


@query("measurement_model_validation")
def measurement_model_validation(v):
    """Scores of withheld readings: pooled, by block, by uncertainty and by distance."""
    far = v.pred_truth.withColumn("distance", (F.col("id") % 1000).cast("int"))
    return parts(pooled=X.predictive_scores(v.pred_truth), blocks=X.block_scores(v.pred_truth), spread=X.uncertainty_bins(v.pred_truth), distance=X.distance_bins(far, [100.0, 300.0]))


def _reference(v) -> DataFrame:
    return v.reference_field.withColumnRenamed("value", "reference")


@query("conditioning_deviation", digits=None)
def conditioning_deviation(v):
    """Deviations of draws from the reference, by draw, by cell and between designs."""
    designs = v.fields_long.withColumn("design", F.col("sample_id") % 4)
    few = {"draws": S.sample_errors(v.fields_long, _reference(v)), "cells": C.bias_and_std(v.fields_long, _reference(v)), "designs": C.design_mixture_variance(designs)}
    # A row for each pair of draws: these are rounded as they are made.
    return rounded(parts(**few)).unionByName(parts(pairs=D.pairwise_rms(v.fields_long, digits=6)))


_GRID = {"y": (1, 0), "x": (0, 1), "diagonal": (1, 1)}


@query("ensemble_coherence")
def ensemble_coherence(v):
    """Histograms, distribution functions, variograms, probe covariances and features of an ensemble."""
    feats = S.field_features(v.fields_long, 1.0).withColumnRenamed("sample_id", "id")
    names = ["mean", "std", "gradient_y", "lag1_y"]
    return parts(
        histogram=D.histogram(v.fields_long, -0.6, 0.6, 60).withColumn("count", F.col("count").cast("double")), ecdf=D.ecdf(v.fields_long, [-0.2, 0.0, 0.2]),
        variogram=P.directional_variograms(v.fields_long, _GRID, [1, 2, 3]).withColumn("distance", F.round("distance", 6).cast("string")), probes=D.probe_covariance(v.fields_long, [(0, 0), (0, 4), (4, 0), (7, 7)]),
        features=D.feature_comparison(feats.where("id >= 100"), feats.where("id < 100"), names),
    )


@query("realistic_permeability")
def realistic_permeability(v):
    """Measurements to a model: quality control, cell means, variogram, summary."""
    values = v.good_points.select("id", "x_m", "y_m", F.col("log10_k").alias("value"))
    return parts(cells=M.cell_means(v.good_points, 800.0), variogram=P.point_variogram(values, 600.0, 100.0), summary=M.measurement_summary(v.good_points, 800.0))


@query("reference_kernel_study")
def reference_kernel_study(v):
    """Which family fits each direction's variogram best, and how well all do."""
    from gridweave.plans.registry import QUERIES

    fits = QUERIES["variogram_fit_grid"](v.spark, v.sf_dir)
    best = fits.groupBy("direction").agg(F.min_by("family", F.struct("rmse", "family")).alias("family"), F.min("rmse").alias("rmse"))
    return parts(fits=fits, best=best)


@query("reference_field_diagnostics")
def reference_field_diagnostics(v):
    """Spectrum, spread and neighbours of the reference beside those of the ensemble."""
    from gridweave.randomfield.fields import spectrum

    arrays = v.table("embeddings").select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("values"))
    rings = spectrum(arrays, 8, 8).groupBy("ring").agg(F.avg("energy").alias("ensemble"), F.max(F.when(F.col("sample_id") == 0, F.col("energy"))).alias("reference"))
    feats = S.field_features(v.fields_long, 1.0)
    own = feats.agg(*(F.avg(c).alias(f"{c}_ensemble") for c in ("std", "lag1_y", "lag1_x")), *(F.max(F.when(F.col("sample_id") == 0, F.col(c))).alias(f"{c}_reference") for c in ("std", "lag1_y", "lag1_x")))
    return parts(spectrum=rings, features=own)


@query("structural_profiles")
def structural_profiles(v):
    """The fitted structure of the fields, with the correlation that a domain of their size has by it."""
    from gridweave.operators.fitting import mean_correlation
    from gridweave.plans.registry import QUERIES

    fit = QUERIES["structural_profile_fit"](v.spark, v.sf_dir)
    r = fit.first()
    inside = v.rows([(mean_correlation(8, 8, r["along"], r["across"], r["angle"]),)], "mean_correlation double")
    return parts(fit=fit, domain=inside)
