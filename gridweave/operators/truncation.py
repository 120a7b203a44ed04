"""Quantities of an expansion's fields by the number of its terms, for all numbers at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridweave.randomfield.continuous import ContinuousExpansion

#: Fields that a task holds at once.
TOGETHER = 256


def partial_quantities(expansion: ContinuousExpansion, xi: DataFrame, terms: list[int], threshold: float) -> DataFrame:
    """sample_id, terms, mean, highest, above of each draw (sample_id, xi): the field's mean and maximum and the share of cells above a threshold.

    A field of more terms is that of fewer and the terms between, so each
    term is added once, whatever the number of truncations.
    """
    if not terms or terms != sorted(set(terms)) or terms[0] < 1 or terms[-1] > expansion.size:
        raise ValueError(f"numbers of terms have to increase from 1 up to {expansion.size} at most")
    y, x = (np.indices((expansion.height, expansion.width)).reshape(2, -1) + 0.5) * expansion.cell
    basis = expansion.basis(x, y)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, TOGETHER):
                part = b.slice(k, TOGETHER)
                draws = np.array(part.column("xi").to_pylist(), float).reshape(part.num_rows, -1)
                field, seen = np.full((part.num_rows, len(basis)), expansion.mean), 0
                for n in terms:
                    field = field + draws[:, seen:n] @ basis[:, seen:n].T
                    seen = n
                    yield pa.RecordBatch.from_arrays(
                        [part.column("sample_id"), pa.array(np.full(len(field), n, "i4")), *map(pa.array, (field.mean(axis=1), field.max(axis=1), (field > threshold).mean(axis=1)))],
                        ["sample_id", "terms", "mean", "highest", "above"],
                    )

    return xi.select("sample_id", "xi").mapInArrow(run, "sample_id long, terms int, mean double, highest double, above double")


def truncation_table(quantities: DataFrame) -> DataFrame:
    """quantity, terms, mean, std, q05, q50, q95, paired_rmse: each draw is paired with itself at the largest number of terms."""
    values = [c for c in quantities.columns if c not in ("sample_id", "terms")]
    long = quantities.unpivot(["sample_id", "terms"], values, "quantity", "value")
    # One shuffle by draw gives each truncation its partner; a draw has a row for each quantity and truncation.
    pairs = long.groupBy("sample_id", "quantity").agg(F.max_by("value", "terms").alias("most"), F.collect_list(F.struct("terms", "value")).alias("each"))
    pairs = pairs.select("quantity", "most", F.explode("each").alias("x")).select("quantity", "x.terms", "x.value", "most")
    d, q = F.col("value") - F.col("most"), F.percentile("value", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q")
    out = pairs.groupBy("quantity", "terms").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), q, F.sqrt(F.avg(d * d)).alias("paired_rmse"))
    return out.select("quantity", "terms", "mean", "std", *(F.col("q")[k].alias(n) for k, n in enumerate(("q05", "q50", "q95"))), "paired_rmse")
