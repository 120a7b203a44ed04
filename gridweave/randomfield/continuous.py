"""Expansions on a grid, read between its cells, and conditioned on points anywhere.

Each axis has the eigenvectors of its cells' correlations. At any place an
eigenfunction is the kernel between the place and the cells times the
eigenvector over its eigenvalue, so it equals the eigenvector at the cells'
centres. A posterior given points is one of the coordinates; it needs sums
over the points only, which are made where the points are.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridweave.randomfield.fields import kernel

#: At most: points of a chunk, draws of a block, places of a chunk that a block is worked out for at once, points that share one row of values.
POINTS, DRAWS, PLACES, SHARING = 10_000, 512, 1024, 64


def _listed(values) -> pa.Array:
    """One row: all values as a list."""
    values = pa.array(values) if isinstance(values, np.ndarray) else values
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


@dataclass(frozen=True)
class ContinuousExpansion:
    """mean + sum of sqrt(energy) xi mode, for a grid of cells of a size whose lower left corner is the origin."""

    height: int
    width: int
    cell: float
    mean: float
    sigma: float
    length: float
    family: str
    values: np.ndarray  # the two axes' eigenvalues of each mode
    vectors: tuple[np.ndarray, np.ndarray]

    @classmethod
    def fit(cls, height: int, width: int, cell: float, mean: float, sigma: float, length: float, family: str = "exponential", share: float = 0.95) -> "ContinuousExpansion":
        """The largest products of the axes' eigenvalues, up to a share of the variance; length in the unit of the cell's size."""

        def axis(n):
            x = (np.arange(n) + 0.5) * cell
            value, vector = np.linalg.eigh(kernel(np.abs(x[:, None] - x) / length, family))
            return value[::-1], vector[:, ::-1]

        (ly, vy), (lx, vx) = axis(height), axis(width)
        products = np.outer(ly, lx).ravel()
        order = np.argsort(-products, kind="stable")
        keep = order[: int(np.searchsorted(np.cumsum(products[order]), share * products.sum())) + 1]
        keep = keep[products[keep] > 1e-12 * products.max()]
        return cls(height, width, cell, mean, sigma, length, family, np.column_stack((ly[keep // width], lx[keep % width])), (vy[:, keep // width], vx[:, keep % width]))

    @property
    def size(self) -> int:
        return len(self.values)

    def basis(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The modes times the roots of their energies at places, a row each; NaN outside the grid."""
        out = np.full((len(x), self.size), self.sigma)
        for k, (at, n) in enumerate(((y, self.height), (x, self.width))):
            centres = (np.arange(n) + 0.5) * self.cell
            near = kernel(np.abs(np.asarray(at)[:, None] - centres) / self.length, self.family)
            out *= near @ self.vectors[k] / np.sqrt(self.values[:, k])
            out[~((at >= 0) & (at <= n * self.cell))] = np.nan
        return out

    def _mapped(self, points: DataFrame, more: list[str], schema: str, f) -> DataFrame:
        """f(basis, batch) as a record batch, over points (x_m, y_m and more)."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(0, b.num_rows, 4096):
                    part = b.slice(k, 4096)
                    x, y = (part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x_m", "y_m"))
                    yield from f(self.basis(x, y), part)

        return points.select(*more, "x_m", "y_m").mapInArrow(run, schema)

    def draws_at(self, points: DataFrame, xi: DataFrame, digits: int | None = None) -> DataFrame:
        """id, sample_id, value of all draws (sample_id, xi) at all points, rounded if digits are given; null outside the grid.

        Points of one place are gathered in chunks, draws in blocks, and each
        chunk meets each block. A place's values are worked out and rounded
        once for all its points of a chunk; their rows are made from them at
        the very end, so neither the tables nor the values pass the driver,
        a broadcast or a shuffle in whole.
        """
        draws = xi.select(F.col("sample_id").cast("long").alias("sample_id"), F.slice("xi", 1, self.size).cast("array<double>").alias("xi"))
        n, least = draws.agg(F.count("*"), F.min(F.coalesce(F.size("xi"), F.lit(0)))).first()
        if n and least < self.size:
            raise ValueError(f"a draw has to have {self.size} coordinates")
        size, mean, most_points, most_draws, at_once, sharing = self.size, self.mean, POINTS, DRAWS, PLACES, SHARING

        def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(0, b.num_rows, most_points):
                    part = b.slice(k, most_points)
                    at = np.column_stack([part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x_m", "y_m")])
                    bits = at.view(np.int64)
                    first = np.flatnonzero(np.append(True, (bits[1:] != bits[:-1]).any(axis=1)))
                    nth = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
                    first = np.flatnonzero(nth % sharing == 0)
                    x, y, points_of = at[first, 0], at[first, 1], np.diff(np.append(first, len(at)))
                    yield pa.RecordBatch.from_arrays([_listed(x), _listed(y), _listed(points_of.astype(np.int32)), _listed(part.column("id"))], ["x", "y", "n", "ids"])

        def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(0, b.num_rows, most_draws):
                    part = b.slice(k, most_draws)
                    yield pa.RecordBatch.from_arrays([_listed(part.column("sample_id")), _listed(part.column("xi").flatten())], ["samples", "xi"])

        def tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    x, y, points_of, ids, samples, xi = (b.column(c)[r].values for c in ("x", "y", "n", "ids", "samples", "xi"))
                    x, y, draws = x.to_numpy(), y.to_numpy(), xi.to_numpy(zero_copy_only=False).reshape(-1, size).T
                    ends = np.append(0, np.cumsum(points_of.to_numpy())).astype(np.int32)
                    for k in range(0, len(x), at_once):
                        values = mean + self.basis(x[k : k + at_once], y[k : k + at_once]) @ draws
                        m, w = values.shape
                        own = ends[k : k + m + 1]
                        every = pa.array(np.arange(m + 1, dtype=np.int32) * w)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.ListArray.from_arrays(pa.array(own - own[0]), ids.slice(own[0], own[-1] - own[0])),
                                pa.ListArray.from_arrays(every, pa.concat_arrays([samples] * m)),
                                pa.ListArray.from_arrays(every, pa.array(values.ravel(), mask=np.isnan(values).ravel())),
                            ],
                            ["ids", "samples", "v"],
                        )

        places = points.select(F.col("id").cast("long").alias("id"), "x_m", "y_m").repartition("x_m", "y_m").sortWithinPartitions("x_m", "y_m")
        left = places.mapInArrow(chunks, "x array<double>, y array<double>, n array<int>, ids array<long>").repartition(points.count() // (4 * POINTS) + 1)
        parts = n // (DRAWS // 2) + 1
        right = draws.repartition(parts).mapInArrow(blocks, "samples array<long>, xi array<double>").repartition(parts)
        found = left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(tiles, "ids array<long>, samples array<long>, v array<double>")
        each = found.select("ids", "samples", F.posexplode("v").alias("pos", "value"))
        value = F.col("value") if digits is None else F.round("value", digits) + F.lit(0.0)
        return each.select("ids", F.get("samples", F.col("pos")).alias("sample_id"), value.alias("value")).select(F.explode("ids").alias("id"), "sample_id", "value")

    def prior_at(self, points: DataFrame) -> DataFrame:
        """id, mean, std at points before any reading."""
        return self._posterior_rows(points, np.zeros(self.size), np.eye(self.size))

    def _posterior_rows(self, points: DataFrame, mean: np.ndarray, covariance: np.ndarray) -> DataFrame:
        def each(basis, part):
            level, spread = self.mean + basis @ mean, np.sqrt(np.maximum(((basis @ covariance) * basis).sum(axis=1), 0))
            out = np.isnan(level)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(level, mask=out), pa.array(spread, mask=out)], ["id", "mean", "std"])

        return self._mapped(points, ["id"], "id long, mean double, std double", each)

    def _sums(self, readings: DataFrame, noise: float) -> np.ndarray:
        """Sums over the readings of (basis, residual) times themselves over the noise, of their number and squared scores.

        Each task adds up its readings to one matrix; only sums over tasks,
        by entry, pass the driver.
        """
        m = self.size + 1

        def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(m * m + 2)
            for b in batches:
                for k in range(0, b.num_rows, 4096):
                    x, y, value = (b.slice(k, 4096).column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x_m", "y_m", "value"))
                    whole = np.column_stack((self.basis(x, y), value - self.mean))
                    whole = whole[np.isfinite(whole).all(axis=1)] / noise
                    out[: m * m] += (whole.T @ whole).ravel()
                    out[m * m] += len(whole)
                    out[m * m + 1] += (whole[:, -1] ** 2 / (1 + (whole[:, :-1] ** 2).sum(axis=1))).sum()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), pa.array(out)], ["entry", "total"])

        found = readings.select("x_m", "y_m", "value").mapInArrow(total, "entry int, total double").groupBy("entry").agg(F.sum("total").alias("total"))
        out = np.zeros(m * m + 2)
        for r in found.collect():
            out[r["entry"]] = r["total"]
        return out

    def posterior(self, readings: DataFrame, noise: float) -> tuple[np.ndarray, np.ndarray, dict]:
        """Mean and covariance of the coordinates given readings (x_m, y_m, value) with a noise above 0, and how the prior foresaw them.

        Readings outside the grid, null or not finite take no part. The third
        part has the number of readings, the mean squared score of each by
        itself, and chi2, that of all together, which the prior expects to be
        their number.
        """
        if not noise > 0:
            raise ValueError("readings at points need a noise above 0")
        sums, m = self._sums(readings, noise), self.size + 1
        whole = sums[: m * m].reshape(m, m)
        covariance = np.linalg.inv(np.eye(m - 1) + whole[:-1, :-1])
        mean = covariance @ whole[:-1, -1]
        n = int(sums[m * m])
        return mean, covariance, {"readings": n, "mean_squared_score": float(sums[-1] / n) if n else math.nan, "chi2": float(whole[-1, -1] - whole[:-1, -1] @ mean)}

    def posterior_at(self, points: DataFrame, readings: DataFrame, noise: float) -> DataFrame:
        """id, mean, std of the noise-free field at points, given all readings."""
        mean, covariance, _ = self.posterior(readings, noise)
        return self._posterior_rows(points, mean, covariance)

    def diagnostics(self, readings: DataFrame, noise: float) -> DataFrame:
        found = self.posterior(readings, noise)[2]
        return readings.sparkSession.createDataFrame([tuple(found.values())], "readings long, mean_squared_score double, chi2 double")
