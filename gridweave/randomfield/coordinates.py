"""Coordinates of samples: iid, Latin hypercube and scrambled Sobol designs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from gridweave.functions.special import ppf


def samples(spark: SparkSession, n: int | DataFrame) -> DataFrame:
    """id of n samples, or of a table that has their ids."""
    return spark.range(n) if isinstance(n, int) else n.select(F.col("id").cast("long").alias("id"))


def drawn(spark: SparkSession, n: int | DataFrame, dimension: int, seed: int, draw: Callable[[np.random.Generator, int], np.ndarray]) -> DataFrame:
    """sample_id, xi: a draw for each sample from its own generator."""

    def run(batches):
        for b in batches:
            ids = b.column("id").to_pylist()
            rows = [draw(np.random.default_rng([seed, i]), dimension).tolist() for i in ids]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(rows, pa.list_(pa.float64()))], ["sample_id", "xi"])

    return samples(spark, n).mapInArrow(run, "sample_id long, xi array<double>")


def iid_gaussian(spark: SparkSession, n: int | DataFrame, dimension: int, seed: int) -> DataFrame:
    return drawn(spark, n, dimension, seed, lambda rng, m: rng.standard_normal(m))


def iid_uniform(spark: SparkSession, n: int | DataFrame, dimension: int, seed: int, low: float = -1.0, high: float = 1.0) -> DataFrame:
    return drawn(spark, n, dimension, seed, lambda rng, m: rng.uniform(low, high, m))


def latin_hypercube(spark: SparkSession, n: int | DataFrame, dimension: int, seed: int, gaussian: bool = False) -> DataFrame:
    """One sample in each of n equal strata of every dimension.

    The strata of a dimension are the ranks of seeded hashes of the samples.
    """
    ids = samples(spark, n)
    n = n if isinstance(n, int) else ids.count()
    x = ids.select(F.col("id").alias("sample_id"), F.explode(F.sequence(F.lit(0), F.lit(dimension - 1))).alias("d"))
    key = F.xxhash64("sample_id", "d", F.lit(seed))
    jitter = F.pmod(F.xxhash64("d", "sample_id", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)
    stratum = F.row_number().over(W.partitionBy("d").orderBy(key, "sample_id")) - 1
    cells = x.withColumn("u", (stratum + jitter) / n).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("d", "u"))).alias("x"))
    u = cells.select("sample_id", F.transform("x", lambda c: c["u"]).alias("u"))
    if not gaussian:
        return u.select("sample_id", F.transform("u", lambda c: 2 * c - 1).alias("xi"))

    def run(batches):
        for b in batches:
            rows = [ppf(np.clip(r, 1e-12, 1 - 1e-12)).tolist() for r in b.column("u").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("sample_id"), pa.array(rows, pa.list_(pa.float64()))], ["sample_id", "xi"])

    return u.mapInArrow(run, "sample_id long, xi array<double>")


def primitive_polynomials(count: int) -> list[tuple[int, int]]:
    """(degree, inner coefficients) of the first primitive polynomials over two elements, by search."""
    out, degree = [], 1
    while len(out) < count:
        for inner in range(1 << max(0, degree - 1)):
            poly, order, x = (1 << degree) | (inner << 1) | 1, 1, 1
            while True:
                x <<= 1
                if x >> degree:
                    x ^= poly
                if x == 1:
                    break
                order += 1
                if order > (1 << degree) - 1:
                    break
            if order == (1 << degree) - 1:
                out.append((degree, inner))
        degree += 1
    return out[:count]


def sobol_directions(dimension: int, bits: int = 30, seed: int = 0) -> np.ndarray:
    """Direction numbers (dimension, bits): van der Corput, then a primitive polynomial a dimension with seeded odd initial numbers."""
    out = np.zeros((dimension, bits), np.int64)
    out[0] = [1 << (bits - 1 - k) for k in range(bits)]
    for d, (s, inner) in enumerate(primitive_polynomials(max(0, dimension - 1)), 1):
        rng = np.random.default_rng([seed, d])
        m = [2 * int(rng.integers(0, 1 << k)) + 1 for k in range(s)]
        for k in range(s, bits):
            new = m[k - s] ^ (m[k - s] << s)
            for j in range(1, s):
                if inner >> (s - 1 - j) & 1:
                    new ^= m[k - j] << j
            m.append(new)
        out[d] = [v << (bits - 1 - k) for k, v in enumerate(m[:bits])]
    return out


def sobol(spark: SparkSession, n: int | DataFrame, dimension: int, seed: int, gaussian: bool = True, bits: int = 30) -> DataFrame:
    """Digitally shifted Sobol points; n is a power of two, or a table of numbers. Each point comes from its own number's Gray code."""
    if isinstance(n, int) and (n < 1 or n & (n - 1)):
        raise ValueError("the number of points has to be a power of two")
    directions = sobol_directions(dimension, bits)
    shift = np.random.default_rng(seed).integers(0, 1 << bits, dimension)

    def run(batches):
        for b in batches:
            ids = b.column("id").to_numpy()
            gray = ids ^ (ids >> 1)
            x = np.tile(shift, (len(ids), 1))
            for k in range(bits):
                x ^= np.where((gray >> k & 1)[:, None] == 1, directions[:, k], 0)
            u = (x + 0.5) / (1 << bits)
            rows = (ppf(u) if gaussian else u).tolist()
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(rows, pa.list_(pa.float64()))], ["sample_id", "xi"])

    return samples(spark, n).mapInArrow(run, "sample_id long, xi array<double>")
