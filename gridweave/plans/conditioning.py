"""Queries of conditioned fields: wells of the points' table, draws and coordinates of the ensemble."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from gridweave.operators.conditioning import NestedConditioner
from gridweave.operators.reconstruction import reconstruction_cases, reconstruction_errors, stopping_counts
from gridweave.operators.scenarios import scenario_mixture, scenario_quantities, scenario_table
from gridweave.operators.selection import variance_locations
from gridweave.operators.truncation import partial_quantities, truncation_table
from gridweave.plans.randomfields import coordinates
from gridweave.plans.registry import query
from gridweave.plans.studies import parts
from gridweave.randomfield.continuous import ContinuousExpansion
from gridweave.sources.views import BACKGROUND

COUNTS, CELL = (2, 8, 32), 1600.0
MEAN, SIGMA, LENGTH = -0.4, 0.4, 3.0


def wells(v):
    """place, row, col, value: the first good well of each cell, by id."""
    cell = [F.floor(F.col(c) / CELL).cast("int").alias(n) for c, n in (("y_m", "row"), ("x_m", "col"))]
    first = v.good_points.select("id", "log10_k", *cell).groupBy("row", "col").agg(F.min("id").alias("id"), F.min_by("log10_k", "id").alias("value"))
    return first.select(F.row_number().over(W.orderBy("id")).alias("place"), "row", "col", "value")  # a row a cell of the grid


def _unit(v):
    return v.fields_long.withColumn("value", 8 * F.col("value"))


def _conditioner(v, noise=0.0):
    return NestedConditioner.fit(wells(v), MEAN, SIGMA, LENGTH, noise=noise)


@query("known_mean_conditioner")
def known_mean_conditioner(v):
    """Mean and spread of each cell, given the first wells, for several numbers of them by one factor."""
    return _conditioner(v).moments(v.reference_field, COUNTS)


@query("condition_prefixes")
def condition_prefixes(v):
    """All draws of the ensemble for all numbers of wells, in one pass over their cells."""
    return _conditioner(v).draws(_unit(v), COUNTS)


@query("native_ensembles")
def native_ensembles(v):
    """Mean and spread of each cell over the conditioned draws, beside the exact ones."""
    drawn = condition_prefixes(v).groupBy("readings", "row", "col").agg(F.count("*").alias("draws"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    exact = known_mean_conditioner(v).withColumnsRenamed({"mean": "exact_mean", "std": "exact_std"})
    return drawn.join(exact, ["readings", "row", "col"])


@query("conditional_blocks")
def conditional_blocks(v):
    """Noisy wells: draws by blocks of cells, how far the wells move each block's draws from the same draws without them, and the exact moments."""
    found, block = _conditioner(v, 0.1), [F.expr(f"int({c} div 4)").alias(f"block_{c}") for c in ("row", "col")]
    drawn = found.draws(_unit(v), [len(found.values)]).withColumnRenamed("value", "given")
    free = _unit(v).select("sample_id", "row", "col", (MEAN + SIGMA * F.col("value")).alias("free"))
    d = F.col("given") - F.col("free")
    moved = drawn.join(free, ["sample_id", "row", "col"]).groupBy(*block).agg(F.count("*").alias("values"), F.avg("given").alias("mean"), F.sqrt(F.avg(d * d)).alias("moved"))
    exact = found.moments(v.reference_field, [len(found.values)]).groupBy(*block).agg(F.avg("mean").alias("exact_mean"), F.sqrt(F.avg(F.col("std") * F.col("std"))).alias("exact_std"))
    return moved.join(exact, ["block_row", "block_col"])


@query("conditional_density_visual")
def conditional_density_visual(v):
    """Spread of conditioned draws by number of wells: over all cells, and at the cell that they tell least about."""
    cells = condition_prefixes(v).groupBy("readings", "row", "col").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("variance"))
    least = known_mean_conditioner(v).where(f"readings = {COUNTS[-1]}").groupBy().agg(F.max_by(F.struct("row", "col"), F.struct("std", "row", "col")).alias("c")).select("c.row", "c.col")
    return parts(whole=cells.groupBy("readings").agg(F.avg("mean").alias("mean"), F.avg("variance").alias("variance")), far=cells.join(F.broadcast(least), ["row", "col"]).select("readings", "mean", "variance"))


@query("conditioning_temperature")
def conditioning_temperature(v):
    """What a surrogate makes of conditioned draws, by number of wells."""
    t = condition_prefixes(v).withColumn("value", BACKGROUND + 4 * F.exp(F.col("value")))
    mean = t.groupBy("readings", "sample_id").agg(F.avg("value").alias("value"))
    return parts(draws=mean.groupBy("readings").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("variance")), cells=t.groupBy("readings", "row", "col").agg(F.stddev_samp("value").alias("std")))


@query("reference_conditioning")
def reference_conditioning(v):
    """Conditioned draws at the wells, which they have to meet, and away from them."""
    pins, drawn = wells(v).withColumnRenamed("value", "given"), condition_prefixes(v)
    at = drawn.join(F.broadcast(pins), ["row", "col"], "left")
    met = F.col("place") <= F.col("readings")
    return parts(
        residual=at.where(met).groupBy("readings").agg(F.max(F.abs(F.col("value") - F.col("given"))).alias("largest")),
        away=at.where(~F.coalesce(met, F.lit(False))).groupBy("readings").agg(F.stddev_samp("value").alias("std")),
    )


@query("density_validation")
def density_validation(v):
    """Predictions from the first wells against the wells of all cells that hold none of them, by number of wells."""
    held = wells(v).withColumnRenamed("value", "truth")
    e = F.col("mean") - F.col("truth")
    inside = (F.abs(e) <= 1.6448536269514722 * F.col("std")).cast("double")
    found = known_mean_conditioner(v).join(held, ["row", "col"]).where("place > readings")
    return parts(scores=found.groupBy("readings").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(inside).alias("coverage"), F.count("*").cast("double").alias("wells")))


def expansion(share=0.95):
    return ContinuousExpansion.fit(8, 8, CELL, MEAN, SIGMA, 4800.0, share=share)


@query("kl_at_points", digits=None)
def kl_at_points(v):
    """The fields of every hundredth sample's coordinates, at all points."""
    return expansion().draws_at(v.points, coordinates(v).where("sample_id % 100 = 0"), digits=6)


@query("kl_conditional_points")
def kl_conditional_points(v):
    """The field at all points, given all wells where they stand, beside what was known before."""
    found = expansion()
    prior = found.prior_at(v.points).select("id", F.col("std").alias("prior_std"))
    return found.posterior_at(v.points, v.good_points.withColumnRenamed("log10_k", "value"), 0.3).join(prior, "id")


@query("kl_conditional_diagnostics")
def kl_conditional_diagnostics(v):
    """How the prior foresaw the wells: each by itself, and all together."""
    return expansion().diagnostics(v.good_points.withColumnRenamed("log10_k", "value"), 0.3)


@query("truncation_sensitivity")
def truncation_sensitivity(v):
    """Quantities of each sample's field by the number of terms, and their paired distances to the full expansion."""
    found = expansion(0.99)
    return truncation_table(partial_quantities(found, coordinates(v), [4, 8, 16, found.size], -0.2))


@query("covariance_reconstruction")
def covariance_reconstruction(v):
    """How many readings of sample 0, at cells that the covariance alone chooses, bring draws within limits of it, and how far they spread by themselves."""
    reference = v.reference_field.select("row", "col", (MEAN + SIGMA * 8 * F.col("value")).alias("reference"))
    cells = reference.select((F.col("row") * 8 + F.col("col")).cast("long").alias("id"), (F.col("col") * CELL).alias("x_m"), (F.col("row") * CELL).alias("y_m"))
    chosen = variance_locations(cells, 16, 1.0, LENGTH * CELL, 4901)
    at = chosen.select("place", F.expr("int(id div 8)").alias("row"), F.expr("int(id % 8)").alias("col"))
    readings = at.join(reference.withColumnRenamed("reference", "value"), ["row", "col"])
    found = NestedConditioner.fit(readings, None, 1.0, LENGTH)
    errors = reconstruction_errors(found, _unit(v).where("sample_id <> 0"), reference, [2, 4, 8, 16], [0.2, SIGMA])
    cases = reconstruction_cases(errors, 0.95, 0.95)
    label = F.col("sigma").cast("string")
    stopping = stopping_counts(cases, [0.2, 0.3, 0.5]).select("quantity", label.alias("sigma"), F.col("limit").cast("string").alias("limit"), *(F.col(f"by_{c}").cast("double").alias(f"by_{c}") for c in ("estimate", "upper")))
    return parts(cases=cases.withColumn("sigma", label), stopping=stopping)


@query("reference_scenarios")
def reference_scenarios(v):
    """Quantities under each covariance family and length, from the same coordinates, by number of draws; and their mixture by equal weights."""
    found = {f"{family} {length:g}": ContinuousExpansion.fit(8, 8, CELL, MEAN, SIGMA, length, family, 0.9) for family in ("matern32", "exponential") for length in (1600.0, 3200.0, 6400.0)}
    table = scenario_table(scenario_quantities(found, coordinates(v), -0.2), [32, 128])
    return parts(scenarios=table, mixture=scenario_mixture(table, dict.fromkeys(found, 1 / len(found))))
