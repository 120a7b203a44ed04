"""Repeated sampling designs: variants, methods and repetitions in one plan.

The key (variant, method, repetition) stays through drawing, evaluation,
prefixes and errors, so all designs are one job. A repetition of the
quasi-random method is the same points under a digital shift of its own; one
of the other has generators of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from gridweave.functions.special import ppf
from gridweave.randomfield.continuous import ContinuousExpansion
from gridweave.randomfield.coordinates import sobol_directions

METHODS, BITS = ("mc", "rqmc"), 30
KEY = ("variant", "method", "repetition")


def design_points(keys: np.ndarray, ids: np.ndarray, quasi: np.ndarray, dimension: int, seed: int, directions: np.ndarray) -> np.ndarray:
    """Standard normal coordinates of samples; keys: variant and repetition of each."""
    out = np.empty((len(ids), dimension))
    for key in np.unique(keys, axis=0):
        own = (keys == key).all(axis=1)
        q = np.nonzero(own & quasi)[0]
        if len(q):
            shift = np.random.default_rng([seed, 1, *key]).integers(0, 1 << BITS, dimension)
            gray, x = ids[q] ^ (ids[q] >> 1), np.tile(shift, (len(q), 1))
            for k in range(BITS):
                x ^= np.where((gray >> k & 1)[:, None] == 1, directions[:, k], 0)
            out[q] = ppf((x + 0.5) / (1 << BITS))
        for i in np.nonzero(own & ~quasi)[0].tolist():
            out[i] = np.random.default_rng([seed, 0, *key, int(ids[i])]).standard_normal(dimension)
    return out


def repeated(variants: DataFrame, expansion: ContinuousExpansion, repetitions: int, budget: int, seed: int) -> DataFrame:
    """variant, method, repetition, sample_id, value: a quantity of the field of each point of all designs.

    variants: variant (int), mean, sigma of its fields' logarithms. The
    expansion has mean 0 and deviation 1; the quantity is the mean of the
    physical field over its cells.
    """
    if budget < 1 or budget & (budget - 1):
        raise ValueError("the budget has to be a power of two")
    y, x = (np.indices((expansion.height, expansion.width)).reshape(2, -1) + 0.5) * expansion.cell
    basis, directions = expansion.basis(x, y), sobol_directions(expansion.size, BITS)
    each = variants.select(F.col("variant").cast("int").alias("variant"), "mean", "sigma", F.explode(F.array(*map(F.lit, METHODS))).alias("method"))
    each = each.select("*", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("repetition"))
    each = each.repartition(*KEY).select("*", F.explode(F.sequence(F.lit(0), F.lit(budget - 1))).alias("sample_id"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                part = b.slice(k, 4096)
                keys = np.column_stack([part.column(c).to_numpy() for c in ("variant", "repetition")])
                quasi = np.array([m == "rqmc" for m in part.column("method").to_pylist()])
                xi = design_points(keys, part.column("sample_id").to_numpy().astype(np.int64), quasi, expansion.size, seed, directions)
                field = part.column("mean").to_numpy()[:, None] + part.column("sigma").to_numpy()[:, None] * (xi @ basis.T)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*KEY, "sample_id")), pa.array(np.power(10.0, field).mean(axis=1))], [*KEY, "sample_id", "value"])

    return each.mapInArrow(run, "variant int, method string, repetition int, sample_id int, value double")


def repeated_prefixes(values: DataFrame, budgets: list[int]) -> DataFrame:
    """variant, method, repetition, budget, mean, std of the first samples of each design, summed once into the first budget that has them."""
    ordered = sorted(set(budgets))
    first = F.element_at(F.filter(F.array(*map(F.lit, ordered)), lambda b: F.col("sample_id") < b), 1)
    v = F.col("value")
    sums = values.withColumn("budget", first).where("budget is not null").groupBy(*KEY, "budget").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(v * v).alias("ss"))
    upto = W.partitionBy(*KEY).orderBy("budget")  # a row a budget
    sums = sums.select(*KEY, "budget", *(F.sum(c).over(upto).alias(c) for c in ("n", "s", "ss")))
    return sums.select(*KEY, "budget", (F.col("s") / F.col("n")).alias("mean"), F.sqrt(F.greatest((F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1), F.lit(0.0))).alias("std"))


def repeated_errors(prefixes: DataFrame) -> DataFrame:
    """variant, method, budget, repetitions, mean, bias, rmse_mean, rmse_std, gain: errors against a pooled reference.

    The reference of a variant is the mean of all its designs' results at the
    largest budget, each of both methods with the same weight. gain is the
    other method's error over the quasi-random one's, null where that is 0.
    """
    top = prefixes.agg(F.max("budget")).first()[0]
    pooled = prefixes.where(F.col("budget") == top).groupBy("variant").agg(F.avg("mean").alias("reference"), F.avg("std").alias("reference_std"))
    d, e = F.col("mean") - F.col("reference"), F.col("std") - F.col("reference_std")
    out = prefixes.join(pooled, "variant").groupBy("variant", "method", "budget").agg(
        F.count("*").alias("repetitions"), F.avg("mean").alias("mean"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse_mean"), F.sqrt(F.avg(e * e)).alias("rmse_std")
    )
    of = lambda m: F.max(F.when(F.col("method") == m, F.col("rmse_mean"))).over(W.partitionBy("variant", "budget"))
    return out.withColumn("gain", of("mc") / F.nullif(of("rqmc"), F.lit(0.0)))
