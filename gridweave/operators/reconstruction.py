"""How well draws that are pinned to readings reconstruct a reference, by number of readings and spread.

With exact readings and an unknown mean, a draw of spread s is the kriged mean
plus s times a residual that s doesn't change. Its error against the reference
is then known from three sums over cells, so one pass over the draws serves
all spreads.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from gridweave.operators.conditioning import NestedConditioner
from gridweave.operators.ranks import ranked, running
from gridweave.operators.summaries import binomial_ranks


def reconstruction_errors(found: NestedConditioner, fields: DataFrame, reference: DataFrame, counts: list[int], sigmas: list[float]) -> DataFrame:
    """readings, sigma, sample_id, error (root mean square against the reference), spread (the same around the kriged mean) of each draw.

    found: of unit spread, without noise and with unknown mean. Draws
    (sample_id, row, col, value) are of standard normal fields; cells without a
    finite reference (row, col, reference) don't count.
    """
    if found.mean is not None or found.sigma != 1 or found.noise:
        raise ValueError("reconstruction takes exact readings of unit spread and unknown mean")
    truth = reference.where(F.abs("reference") < float("inf")).select("row", "col", "reference")
    apart = found.moments(truth, counts).join(truth, ["row", "col"]).select("readings", "row", "col", "mean", (F.col("mean") - F.col("reference")).alias("d"))
    both = found.draws(fields, counts).join(apart, ["readings", "row", "col"])
    d, r = F.col("d"), F.col("value") - F.col("mean")
    sums = both.groupBy("readings", "sample_id").agg(F.avg(d * d).alias("dd"), F.avg(d * r).alias("dr"), F.avg(r * r).alias("rr"))
    s = F.explode(F.lit([float(x) for x in sigmas])).alias("sigma")
    square = F.col("dd") + 2 * F.col("sigma") * F.col("dr") + F.col("sigma") * F.col("sigma") * F.col("rr")
    each = sums.select("*", s)
    return each.select("readings", "sigma", "sample_id", F.sqrt(F.greatest(square, F.lit(0.0))).alias("error"), (F.col("sigma") * F.sqrt("rr")).alias("spread"))


def reconstruction_cases(errors: DataFrame, probability: float, confidence: float) -> DataFrame:
    """quantity (error, spread), readings, sigma, draws, estimate of the quantile, lower and upper end of its distribution-free interval (null: infinite), mean square."""
    n = errors.select("sample_id").distinct().count()
    low, high = binomial_ranks(n, probability, confidence)
    rank = max(1, math.ceil(probability * n - 1e-9))
    keys = ("quantity", "readings", "sigma")
    long = errors.unpivot(["readings", "sigma", "sample_id"], ["error", "spread"], "quantity", "value").withColumn("n", F.lit(1))
    square = F.sum(F.col("value") * F.col("value") * F.col("n")) / F.sum("n")
    cases = running(long, ["n"], by=keys).groupBy(*keys).agg(F.sum("n").alias("draws"), ranked(rank).alias("estimate"), ranked(low).alias("lower"), ranked(high).alias("upper"), square.alias("mean_square"))
    # By Markov's inequality of the mean square, for the same share of draws.
    return cases.withColumn("markov_bound", F.sqrt(F.col("mean_square") / (1 - probability)))


def stopping_counts(cases: DataFrame, limits: list[float]) -> DataFrame:
    """quantity, sigma, limit, and the fewest readings whose estimate, and whose upper end, is no larger; null if none is."""
    each = cases.select("*", F.explode(F.lit([float(x) for x in limits])).alias("limit"))
    fewest = lambda c: F.min(F.when(F.col(c) <= F.col("limit"), F.col("readings")))
    return each.groupBy("quantity", "sigma", "limit").agg(fewest("estimate").alias("by_estimate"), fewest("upper").alias("by_upper"))
