"""Statistics of each cell over the samples of an ensemble.

Inputs are long: sample_id, row, col, value. All are partial aggregates by
cell; nothing depends on how rows are batched. Values that are not finite
have to be refused first (``guards``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CELL = ["row", "col"]


def variance(value: Column | str, ddof: int = 1) -> Column:
    return {0: F.var_pop, 1: F.var_samp}[ddof](value)


def field_statistics(fields: DataFrame, ddof: int = 1) -> DataFrame:
    """count, mean, variance, std, min, max; std and variance are null where count <= ddof."""
    out = fields.groupBy(*CELL).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.greatest(variance("value", ddof), F.lit(0.0)).alias("variance"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    return out.withColumn("variance", F.when(F.col("count") > ddof, F.col("variance"))).withColumn("std", F.sqrt("variance"))


def _thresholds(fields: DataFrame, thresholds: list[float]) -> DataFrame:
    if not thresholds or len(set(thresholds)) < len(thresholds):
        raise ValueError("thresholds have to be distinct, and one at least")
    return fields.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))


def _exceeds(delta: Column, threshold: Column, comparison: str, kind: str) -> Column:
    """The comparison at the field's own type, so that a boundary value is one."""
    a, b = delta.cast(kind), threshold.cast(kind)
    return {">=": a >= b, ">": a > b}[comparison]


def exceedance_probability(
    fields: DataFrame, background: float, thresholds: list[float], comparison: str = ">=", kind: str = "float"
) -> DataFrame:
    """threshold, row, col, probability that value - background exceeds it."""
    hit = _exceeds(F.col("value") - background, F.col("threshold"), comparison, kind)
    return _thresholds(fields, thresholds).groupBy("threshold", *CELL).agg(F.avg(hit.cast("double")).alias("probability"))


def expected_excess(fields: DataFrame, background: float, thresholds: list[float]) -> DataFrame:
    """threshold, row, col, mean of max(value - background - threshold, 0)."""
    over = F.greatest(F.col("value") - background - F.col("threshold"), F.lit(0.0))
    return _thresholds(fields, thresholds).groupBy("threshold", *CELL).agg(F.avg(over).alias("expected_excess"))


def field_quantiles(fields: DataFrame) -> DataFrame:
    """q05, q50, q95 (linear interpolation, exact) and width90 = q95 - q05."""
    q = F.percentile("value", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = fields.groupBy(*CELL).agg(q.alias("q"))
    return out.select(*CELL, *(F.col("q")[k].alias(n) for k, n in enumerate(("q05", "q50", "q95"))), (F.col("q")[2] - F.col("q")[0]).alias("width90"))


def risk_and_statistics(fields: DataFrame, background: float, threshold: float) -> DataFrame:
    """Statistics, quantiles, exceedance probability and expected excess in one aggregate."""
    delta = F.col("value") - background
    out = fields.groupBy(*CELL).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.percentile("value", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"),
        F.avg((delta.cast("float") >= F.lit(threshold).cast("float")).cast("double")).alias("probability"),
        F.avg(F.greatest(delta - threshold, F.lit(0.0))).alias("expected_excess"),
    )
    q = F.col("q")
    return out.withColumns({"q05": q[0], "q50": q[1], "q95": q[2], "width90": q[2] - q[0]}).drop("q")


def log10_statistics(fields: DataFrame) -> DataFrame:
    """Per cell statistics of log10 of positive values."""
    return field_statistics(fields.withColumn("value", F.log10("value")))


def conditioning_residuals(fields: DataFrame, observations: DataFrame) -> DataFrame:
    """sample_id, max_abs: the largest residual at observed cells (row, col, observed)."""
    met = fields.join(observations, CELL)
    return met.groupBy("sample_id").agg(F.max(F.abs(F.col("value") - F.col("observed"))).alias("max_abs"))


def budget_moments(fields: DataFrame, budget: int) -> DataFrame:
    """Mean and variance over the first ``budget`` samples; order is the sample id's."""
    return fields.where(F.col("sample_id") < budget).groupBy(*CELL).agg(F.avg("value").alias("mean"), F.var_samp("value").alias("variance"))


def design_mixture_variance(fields: DataFrame) -> DataFrame:
    """Law of total variance over designs (column design): within, between (population) and their sum."""
    own = fields.groupBy("design", *CELL).agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    out = own.groupBy(*CELL).agg(F.avg("v").alias("within"), F.var_pop("m").alias("between"))
    return out.withColumn("mixture", F.col("within") + F.col("between"))


def bias_and_std(fields: DataFrame, reference: DataFrame) -> DataFrame:
    """Per cell mean and std of value minus the reference's (row, col, reference)."""
    delta = F.col("value") - F.col("reference")
    return fields.join(reference, CELL).groupBy(*CELL).agg(F.avg(delta).alias("bias"), F.stddev_samp(delta).alias("std"))


def heldout_coverage(fields: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: share of truth (row, col, truth) in the cells' 5 to 95 % range, RMSE and MAE of their means."""
    cell = fields.groupBy(*CELL).agg(F.percentile("value", F.array(F.lit(0.05), F.lit(0.95))).alias("q"), F.avg("value").alias("mean"))
    error = F.col("mean") - F.col("truth")
    return cell.join(truth, CELL).agg(
        F.avg(F.col("truth").between(F.col("q")[0], F.col("q")[1]).cast("double")).alias("coverage"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
    )
