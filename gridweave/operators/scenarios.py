"""Quantities of fields under several structural scenarios, which are drawn from the same coordinates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridweave.operators.truncation import TOGETHER
from gridweave.randomfield.continuous import ContinuousExpansion

QUANTITIES = ("mean", "highest", "above")


def scenario_quantities(expansions: dict[str, ContinuousExpansion], xi: DataFrame, threshold: float) -> DataFrame:
    """scenario, sample_id, mean, highest, above of each draw (sample_id, xi) under each scenario, in one pass over the draws.

    A scenario takes as many of a draw's numbers as it has terms; draws with
    fewer, or without any, raise.
    """
    bases = {}
    for name, e in expansions.items():
        y, x = (np.indices((e.height, e.width)).reshape(2, -1) + 0.5) * e.cell
        bases[name] = (e.mean, e.basis(x, y))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, TOGETHER):
                part = b.slice(k, TOGETHER)
                draws = np.array(part.column("xi").to_pylist(), float).reshape(part.num_rows, -1)
                for name, (mean, basis) in bases.items():
                    if draws.shape[1] < basis.shape[1]:
                        raise ValueError(f"{name} has {basis.shape[1]} terms, draws have {draws.shape[1]}")
                    field = mean + draws[:, : basis.shape[1]] @ basis.T
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(field)), part.column("sample_id"), *map(pa.array, (field.mean(axis=1), field.max(axis=1), (field > threshold).mean(axis=1)))],
                        ["scenario", "sample_id", *QUANTITIES],
                    )

    return xi.select("sample_id", "xi").mapInArrow(run, "scenario string, sample_id long, mean double, highest double, above double")


def scenario_table(quantities: DataFrame, draws: list[int]) -> DataFrame:
    """scenario, draws, quantity, n, average, variance of the draws with ids below each number; scenarios aren't pooled."""
    long = quantities.unpivot(["scenario", "sample_id"], list(QUANTITIES), "quantity", "value")
    each = long.select("scenario", "quantity", "sample_id", "value", F.explode(F.lit(sorted(map(int, draws)))).alias("draws")).where("sample_id < draws")
    return each.groupBy("scenario", "draws", "quantity").agg(F.count("*").alias("n"), F.avg("value").alias("average"), F.var_samp("value").alias("variance"))


def scenario_mixture(table: DataFrame, weights: dict[str, float]) -> DataFrame:
    """draws, quantity, average, within, between: the mixture of scenarios by stated weights, its variance apart.

    Weights are assumptions of the caller: one of at least 0 for each scenario, that sum to 1.
    """
    if not weights or min(weights.values()) < 0 or abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights of scenarios are at least 0 and sum to 1")
    own = F.element_at(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)), F.col("scenario"))
    w = F.coalesce(own, F.raise_error(F.concat(F.lit("no weight of "), F.col("scenario"))).cast("double"))
    rows = table.withColumn("w", w).groupBy("draws", "quantity")
    mean = F.sum(F.col("w") * F.col("average"))
    return rows.agg(mean.alias("average"), F.sum(F.col("w") * F.col("variance")).alias("within"), (F.sum(F.col("w") * F.col("average") * F.col("average")) - mean * mean).alias("between"))
