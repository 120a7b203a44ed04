"""Predictive scores, ensembles against truth, error metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridweave.functions.scalars import Z95, safe_divide
from gridweave.operators.samples import relative_l2
from gridweave.operators.summaries import quantiles


def rmse(e: Column) -> Column:
    return F.sqrt(F.avg(e * e))


def ensemble_scores(draws: DataFrame, by: tuple[str, ...] = ("trial", "truth")) -> DataFrame:
    """CRPS, rank of the truth, mean, spread and error of the mean over draws.

    CRPS = mean |x - y| - sum (2i - n - 1) x_(i) / n^2 over the sorted draws.
    """
    w = W.partitionBy(*by)
    x = draws.withColumns({"i": F.row_number().over(w.orderBy("value")), "n": F.count("*").over(w)})
    own = F.sum((2 * F.col("i") - F.col("n") - 1) * F.col("value")) / (F.count("*") * F.count("*"))
    return x.groupBy(*by).agg(
        F.count("*").alias("n"), (F.avg(F.abs(F.col("value") - F.col("truth"))) - own).alias("crps"), F.count_if(F.col("value") < F.col("truth")).alias("rank"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
    )


def rank_interval(scores: DataFrame, level: float) -> DataFrame:
    """scores with pit (mid of the rank's interval) and whether the rank stands in the central share ``level``."""
    pit = (F.col("rank") + 0.5) / (F.col("n") + 1)
    tail = (1 - level) / 2
    return scores.withColumns({"pit": pit, "covered": (pit >= tail) & (pit <= 1 - tail)})


def calibration(scores: DataFrame, bins: int, level: float) -> DataFrame:
    """Rank histogram with empty bins, and beside each bin the overall coverage, CRPS, RMSE and spread."""
    x = rank_interval(scores, level)
    error = F.col("mean") - F.col("truth")
    every = x.agg(
        F.avg(F.col("covered").cast("double")).alias("coverage"), F.avg("crps").alias("mean_crps"), rmse(error).alias("rmse"), F.sqrt(F.avg(F.col("sd") * F.col("sd"))).alias("rms_sd")
    )
    own = x.groupBy(F.least(F.floor(F.col("pit") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("count"))
    grid = scores.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(own, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count")).join(F.broadcast(every))


#: Standard normal quantiles of the central shares.
CENTRAL = {"50": 0.6744897501960817, "68": 0.9944578832097535, "80": 1.2815515655446004, "90": Z95, "95": 1.959963984540054}


def predictive_scores(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Errors, reliability at five levels, standardized errors and NLPD; what needs a positive std is null if one is 0."""
    e, s = F.col("truth") - F.col("mean"), F.col("std")
    z, sound = F.when(s > 0, e / s), F.min(s) > 0
    nlpd = F.when(s > 0, 0.5 * math.log(2 * math.pi) + F.log(s) + e * e / (2 * s * s))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), rmse(e).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(-e).alias("bias"), F.sqrt(F.avg(s * s)).alias("rms_sd"),
        *(F.avg((F.abs(e) <= q * s).cast("double")).alias(f"within_{n}") for n, q in CENTRAL.items()),
        F.when(sound, rmse(z)).alias("z_rmse"), F.when(sound, F.avg(z)).alias("z_bias"), F.when(sound, F.stddev_pop(z)).alias("z_std"), F.when(sound, F.avg(nlpd)).alias("nlpd"),
    )


def uncertainty_bins(df: DataFrame, k: int = 5) -> DataFrame:
    """Scores in bins of std by its quantiles; equal edges make one bin."""
    edges = df.agg(F.array_distinct(quantiles("std", tuple(i / k for i in range(1, k)))).alias("edges"))
    binned = df.join(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("std"))))
    return predictive_scores(binned, ("bin",))


def distance_bins(df: DataFrame, edges: list[float]) -> DataFrame:
    """Scores in half-open bins of distance, the last without end."""
    b = F.lit(0)
    for e in edges:
        b = b + (F.col("distance") >= e).cast("int")
    return predictive_scores(df.withColumn("bin", b), ("bin",))


def block_scores(df: DataFrame) -> DataFrame:
    """One row: scores of blocks, each block counting the same."""
    own = predictive_scores(df, ("block",))
    return own.agg(F.count("*").alias("blocks"), *(F.avg(c).alias(c) for c in ("rmse", "mae", "bias", "within_90", "nlpd")))


def error_metrics(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """MAE, MSE, RMSE, largest error and bias of prediction - reference."""
    e = F.col("prediction") - F.col("reference")
    return df.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), rmse(e).alias("rmse"), F.max(F.abs(e)).alias("max_abs"), F.avg(e).alias("bias"))


def error_percentiles(df: DataFrame) -> DataFrame:
    """Percentiles of |e|, and shares strictly above thresholds at the field's own type."""
    e = F.abs(F.col("prediction") - F.col("reference"))
    q = quantiles(e, (0.5, 0.9, 0.95, 0.99, 0.999))
    above = {"above_01": 0.1, "above_05": 0.5, "above_10": 1.0}
    out = df.agg(q.alias("q"), *(F.avg((e.cast("float") > F.lit(t).cast("float")).cast("double")).alias(n) for n, t in above.items()))
    return out.withColumns({n: F.col("q")[k] for k, n in enumerate(("p50", "p90", "p95", "p99", "p999"))}).drop("q")


def difference_metrics(df: DataFrame) -> DataFrame:
    e = F.col("prediction") - F.col("reference")
    return df.agg(F.max(F.abs(e)).alias("max_abs"), F.avg(F.abs(e)).alias("mean_abs"), rmse(e).alias("rmse"), relative_l2(e, F.col("reference")).alias("relative_l2"))


def log_residuals(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Of log10 prediction and reference; correlation is null for fewer than two rows or a constant side."""
    e = F.col("prediction") - F.col("reference")
    flat = F.var_pop("prediction") * F.var_pop("reference") == 0
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), rmse(e).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"),
        F.when((F.count("*") >= 2) & ~flat, F.corr("prediction", "reference")).alias("correlation"),
        *(F.avg((F.abs(e) <= t).cast("double")).alias(f"within_{n}") for n, t in (("005", 0.05), ("010", 0.1), ("030", 0.3))),
        F.percentile(F.pow(F.lit(10.0), e), F.lit(0.5)).alias("median_ratio"),
    )


def response_diagnostics(df: DataFrame) -> DataFrame:
    """RMSE, MAE, largest error, relative L2, Q2 = 1 - SSE/SST and moments of both sides; a constant reference gives Q2 1 or minus infinity."""
    e = F.col("prediction") - F.col("reference")
    sse, sst = F.sum(e * e), F.var_pop("reference") * F.count("*")
    q2 = F.when(sst > 0, 1 - sse / sst).when(sse == 0, 1.0).otherwise(F.lit(float("-inf")))
    return df.agg(
        rmse(e).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.max(F.abs(e)).alias("max_abs"), relative_l2(e, F.col("reference")).alias("relative_l2"), q2.alias("q2"),
        F.avg("prediction").alias("mean_prediction"), F.avg("reference").alias("mean_reference"), F.var_samp("prediction").alias("var_prediction"), F.var_samp("reference").alias("var_reference"),
    )


def gain(a: Column, b: Column) -> Column:
    return safe_divide(a, b)
