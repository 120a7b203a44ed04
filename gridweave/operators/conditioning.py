"""Conditioning of many draws on growing numbers of readings, by one factor.

The readings' covariance is factored once, for all of them. The first n rows
of its Cholesky factor are the factor of the first n readings, and forward
substitution goes row by row, so the whitened residuals and the whitened
covariances of a cell serve every prefix of the readings: what a draw gains by
further readings is added to what it had. Each prefix costs no system of its own.

Cells go by tiles of bounded size. A tile's whitened covariances are made once
in a task and used for all draws and all prefixes there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridweave.randomfield.fields import kernel

#: Readings of one dense factor, at most; more are refused.
MOST_READINGS = 4096
#: Cells along the side of a tile.
TILE = 64


def _counts(counts, n: int) -> list[int]:
    counts = list(counts)
    if not counts or counts != sorted(set(counts)) or counts[0] < 1 or counts[-1] > n:
        raise ValueError(f"counts of readings have to increase from 1 up to {n} at most")
    return counts


@dataclass(frozen=True)
class NestedConditioner:
    """Readings at distinct cells (row, col), in order, of a field whose mean is known, or None; inverse: that of the Cholesky factor.

    A mean that isn't known is one constant with a flat prior, estimated by
    each prefix from its own readings: its whitened ones and residuals are
    running sums too, so it needs no further system either.
    """

    at: np.ndarray
    values: np.ndarray
    mean: float | None
    sigma: float
    length: float
    family: str
    noise: float
    inverse: np.ndarray

    @classmethod
    def fit(cls, readings: DataFrame, mean: float | None, sigma: float, length: float, family: str = "matern32", noise: float = 0.0) -> "NestedConditioner":
        """Of readings (place, row, col, value), by place; at most MOST_READINGS of them, at distinct cells."""
        rows = readings.select("place", "row", "col", "value").orderBy("place").limit(MOST_READINGS + 1).collect()
        if not 0 < len(rows) <= MOST_READINGS:
            raise ValueError(f"1 to {MOST_READINGS} readings are conditioned on at once, not {len(rows)} or more")
        at, values = np.array([(r["row"], r["col"]) for r in rows], float), np.array([r["value"] for r in rows], float)
        if len(np.unique(at, axis=0)) < len(at) or not np.isfinite(values).all():
            raise ValueError("readings have to be finite and at distinct cells")
        c = sigma**2 * kernel(np.hypot(*(at[:, None] - at).transpose(2, 0, 1)) / length, family) + noise**2 * np.eye(len(at))
        return cls(at, values, mean, sigma, length, family, noise, np.linalg.solve(np.linalg.cholesky(c), np.eye(len(at))))

    def features(self, cells: np.ndarray) -> np.ndarray:
        """Whitened covariances of cells and readings: a row for each cell."""
        d = np.hypot(cells[:, :1] - self.at[:, 0], cells[:, 1:] - self.at[:, 1])
        return self.sigma**2 * kernel(d / self.length, self.family) @ self.inverse.T

    def _estimates(self, whitened: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each prefix, the constant that its whitened values estimate, and that estimate's precision."""
        ones = self.inverse.sum(axis=1)
        precision = np.cumsum(ones * ones)
        return np.cumsum(ones * whitened) / precision, precision

    def moments(self, cells: DataFrame, counts) -> DataFrame:
        """readings, row, col, mean, std of each cell given the first so many readings."""
        counts, known_mean = _counts(counts, len(self.at)), self.mean or 0.0
        whitened, ones = self.inverse @ (self.values - known_mean), self.inverse.sum(axis=1)
        estimate, precision = self._estimates(whitened)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(0, b.num_rows, TILE * TILE):
                    part = b.slice(k, TILE * TILE)
                    f = self.features(np.column_stack([part.column(c).to_numpy().astype(float) for c in ("row", "col")]))
                    mean, known = np.cumsum(f * whitened, axis=1), np.cumsum(f * f, axis=1)
                    for n in counts:
                        left, middle = self.sigma**2 - known[:, n - 1], known_mean + mean[:, n - 1]
                        if self.mean is None:
                            apart = 1 - f[:, :n] @ ones[:n]
                            left, middle = left + apart**2 / precision[n - 1], middle + apart * estimate[n - 1]
                        if left.min(initial=0) < -1e-8 * self.sigma**2:
                            raise ArithmeticError("a conditional variance is negative")
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(f), n, "i4")), part.column("row"), part.column("col"), pa.array(middle), pa.array(np.sqrt(np.maximum(left, 0)))],
                            ["readings", "row", "col", "mean", "std"],
                        )

        return cells.select(*(F.col(c).cast("int").alias(c) for c in ("row", "col"))).mapInArrow(run, "readings int, row int, col int, mean double, std double")

    def draws(self, fields: DataFrame, counts, seed: int = 0) -> DataFrame:
        """readings, sample_id, row, col, value: draws of standard normal fields (sample_id, row, col, value), given the first so many readings.

        A draw has to have all cells with readings; other cells may be missing.
        A value that isn't finite raises, as nothing stands in for it. Noisy
        readings get simulated noise for each draw, from seed and draw alone,
        which all prefixes share.
        """
        counts, n, known_mean, ones = _counts(counts, len(self.at)), len(self.at), self.mean or 0.0, self.inverse.sum(axis=1)
        spark = fields.sparkSession
        fields = fields.select("sample_id", *(F.col(c).cast("int").alias(c) for c in ("row", "col")), F.col("value").cast("double").alias("value"))
        places = spark.createDataFrame([(k, int(r), int(c)) for k, (r, c) in enumerate(self.at)], "place int, row int, col int")
        own = fields.join(F.broadcast(places), ["row", "col"]).groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("own"))
        own = own.select("sample_id", F.col("own.value").alias("own"))
        tile = [F.floor(F.col(c) / TILE).cast("int").alias(f"tile_{c}") for c in ("row", "col")]
        cells = F.sort_array(F.collect_list(F.struct("row", "col", "value")))
        tiles = fields.groupBy("sample_id", *tile).agg(cells.alias("cells"))
        tiles = tiles.join(own, "sample_id").select("sample_id", "tile_row", "tile_col", *(F.col(f"cells.{c}").alias(c) for c in ("row", "col", "value")), "own")
        order = ["tile_row", "tile_col", "sample_id"]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, f = None, None
            for b in batches:
                for k in range(b.num_rows):
                    row, col, value, own = (b.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("row", "col", "value", "own"))
                    if len(own) != n or not (np.isfinite(value).all() and np.isfinite(own).all()):
                        raise ValueError("a draw has missing or non-finite values")
                    key = (row.tobytes(), col.tobytes())
                    if key != held:
                        held, f = key, self.features(np.column_stack((row, col)).astype(float))
                    told = self.noise * np.random.default_rng([seed, b.column("sample_id")[k].as_py()]).standard_normal(n) if self.noise else 0.0
                    whitened = self.inverse @ (self.values - known_mean - self.sigma * own - told)
                    estimate, _ = self._estimates(whitened)
                    now, seen, size = known_mean + self.sigma * value, 0, len(value)
                    for m in counts:
                        now = now + f[:, seen:m] @ whitened[seen:m]
                        seen = m
                        conditioned = now if self.mean is not None else now + (1 - f[:, :m] @ ones[:m]) * estimate[m - 1]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(size, m, "i4")), pa.array(np.full(size, b.column("sample_id")[k].as_py(), "i8")), pa.array(row), pa.array(col), pa.array(conditioned)],
                            ["readings", "sample_id", "row", "col", "value"],
                        )

        # By ranges of tile and draw: one tile's draws meet, and where they are many several tasks share them.
        dealt = tiles.repartitionByRange(*order).sortWithinPartitions(*order)
        return dealt.mapInArrow(run, "readings int, sample_id long, row int, col int, value double")
