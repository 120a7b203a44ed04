"""Random fields from coordinates or seeds, free and conditioned on data."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridweave.randomfield.coordinates import samples

FIELD = "sample_id long, values array<double>"


def kernel(h: np.ndarray, family: str) -> np.ndarray:
    return {"exponential": lambda x: np.exp(-x), "gaussian": lambda x: np.exp(-x * x / 2), "matern32": lambda x: (1 + math.sqrt(3) * x) * np.exp(-math.sqrt(3) * x)}[family](h)


def to_long(fields: DataFrame, width: int) -> DataFrame:
    """sample_id, row, col, value of fields held as arrays, row by row."""
    flat = fields.select("sample_id", F.posexplode("values").alias("pos", "value"))
    return flat.select("sample_id", F.expr(f"int(pos div {width})").alias("row"), (F.col("pos") % width).cast("int").alias("col"), "value")


def _mapped(df: DataFrame, column: str, f) -> DataFrame:
    """sample_id, values: f of the matrix of a batch's arrays."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                out = f(np.array(part.column(column).to_pylist(), float), part.column("sample_id").to_numpy())
                yield pa.RecordBatch.from_arrays([part.column("sample_id"), pa.array(out.tolist(), pa.list_(pa.float64()))], ["sample_id", "values"])

    return df.select("sample_id", column).mapInArrow(run, FIELD)


@dataclass(frozen=True)
class Expansion:
    """Separable Karhunen-Loeve expansion on a grid: mean + sum of sqrt(energy) xi mode."""

    height: int
    width: int
    mean: float
    energies: np.ndarray
    modes: np.ndarray

    @classmethod
    def fit(cls, height: int, width: int, mean: float, sigma: float, length: float, family: str = "exponential", share: float = 0.95) -> "Expansion":
        """The largest products of the two axes' eigenvalues, up to a share of the variance."""

        def axis(n):
            x = np.arange(n)
            value, vector = np.linalg.eigh(kernel(np.abs(x[:, None] - x) / length, family))
            return value[::-1], vector[:, ::-1]

        (ly, vy), (lx, vx) = axis(height), axis(width)
        products = np.outer(ly, lx).ravel()
        order = np.argsort(-products, kind="stable")
        keep = order[: int(np.searchsorted(np.cumsum(products[order]), share * products.sum())) + 1]
        modes = np.einsum("im,jm->ijm", vy[:, keep // width], vx[:, keep % width]).reshape(height * width, -1)
        return cls(height, width, mean, sigma * sigma * products[keep], modes)

    @property
    def basis(self) -> np.ndarray:
        return self.modes * np.sqrt(self.energies)

    def variance(self) -> np.ndarray:
        return (self.basis**2).sum(axis=1)

    def map(self, xi: DataFrame) -> DataFrame:
        basis, mean = self.basis, self.mean
        return _mapped(xi, "xi", lambda x, _: mean + x[:, : basis.shape[1]] @ basis.T)

    def conditioned(self, cells: list[int], values: list[float], noise: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Mean and factor of the coordinates given values at cells; incompatible exact data raise."""
        a, d = self.basis[cells], np.asarray(values, float) - self.mean
        gram = a @ a.T + noise * noise * np.eye(len(cells))
        gain = a.T @ np.linalg.pinv(gram, rcond=1e-10, hermitian=True)
        mean = gain @ d
        if noise == 0 and not np.allclose(a @ mean, d, atol=1e-6):
            raise ValueError("the expansion can't meet these data exactly")
        left = np.eye(a.shape[1]) - gain @ a
        value, vector = np.linalg.eigh((left + left.T) / 2)
        return mean, vector * np.sqrt(np.maximum(value, 0))

    def map_conditioned(self, xi: DataFrame, cells: list[int], values: list[float], noise: float = 0.0) -> DataFrame:
        mean, factor = self.conditioned(cells, values, noise)
        basis, level = self.basis, self.mean
        return _mapped(xi, "xi", lambda x, _: level + (mean + x[:, : len(mean)] @ factor.T) @ basis.T)


def fft_fields(spark: SparkSession, n: int | DataFrame, height: int, width: int, sigma: float, length: float, seed: int, family: str = "exponential") -> DataFrame:
    """Stationary fields by circulant embedding on a grid of at least three times the size; small negative energies are clamped, large ones raise."""
    h, w = (1 << math.ceil(math.log2(3 * s)) for s in (height, width))
    dy, dx = np.minimum(np.arange(h), h - np.arange(h)), np.minimum(np.arange(w), w - np.arange(w))
    energy = np.fft.fft2(sigma * sigma * kernel(np.hypot(dy[:, None], dx) / length, family)).real
    if energy.min() < -1e-2 * energy.max():
        raise ValueError("the embedding is too small for this length")
    root = np.sqrt(np.maximum(energy, 0))

    def one(seeded: int) -> np.ndarray:
        rng = np.random.default_rng([seed, seeded])
        noise = rng.standard_normal((h, w)) + 1j * rng.standard_normal((h, w))
        return np.fft.fft2(root * noise).real[:height, :width] / math.sqrt(h * w)

    def run(batches):
        for b in batches:
            for i in b.column("id").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([one(i).ravel().tolist()], pa.list_(pa.float64()))], ["sample_id", "values"])

    return samples(spark, n).mapInArrow(run, FIELD)


def inverted(c: np.ndarray) -> np.ndarray:
    """The inverse of a symmetric matrix; its pseudoinverse where that is no inverse to six digits."""
    try:
        found = np.linalg.inv(c)
        if np.abs(c @ found - np.eye(len(c))).max() < 1e-6:
            return (found + found.T) / 2
    except np.linalg.LinAlgError:
        pass
    return np.linalg.pinv(c, rcond=1e-12, hermitian=True)


@dataclass(frozen=True)
class Kriging:
    """A solved system of few observations at points (x, y): simple with a known mean, ordinary without."""

    at: np.ndarray
    values: np.ndarray
    mean: float | None
    sigma: float
    length: float
    family: str
    inverse: np.ndarray

    @classmethod
    def fit(cls, at, values, sigma: float, length: float, mean: float | None = None, nugget: float = 0.0, family: str = "exponential") -> "Kriging":
        at, values = np.asarray(at, float), np.asarray(values, float)
        c = sigma * sigma * kernel(np.hypot(*(at[:, None] - at).transpose(2, 0, 1)) / length, family) + nugget * np.eye(len(at))
        if mean is None:
            one = np.ones((len(at), 1))
            c = np.block([[c, one], [one.T, np.zeros((1, 1))]])
        return cls(at, values, mean, sigma, length, family, inverted(c))

    def _cross(self, x: np.ndarray) -> np.ndarray:
        d = np.hypot(x[:, :1] - self.at[:, 0], x[:, 1:] - self.at[:, 1])
        c = self.sigma**2 * kernel(d / self.length, self.family)
        return c if self.mean is not None else np.column_stack((c, np.ones(len(x))))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and variance at points."""
        c = self._cross(x)
        weights = c @ self.inverse
        if self.mean is not None:
            mean = self.mean + weights @ (self.values - self.mean)
        else:
            mean = weights[:, :-1] @ self.values
        return mean, np.maximum(self.sigma**2 - (weights * c).sum(axis=1), 0)

    def map(self, points: DataFrame, places: bool = False) -> DataFrame:
        """id, mean, variance of points (id, x_m, y_m); with ``places`` x_m and y_m besides."""
        more = ["x_m", "y_m"] if places else []

        def run(batches):
            for b in batches:
                x = np.column_stack([b.column(c).to_numpy() for c in ("x_m", "y_m")])
                mean, variance = self.predict(x)
                yield pa.RecordBatch.from_arrays([b.column("id"), *(b.column(c) for c in more), pa.array(mean), pa.array(variance)], ["id", *more, "mean", "variance"])

        return points.select("id", "x_m", "y_m").mapInArrow(run, "id long, " + "".join(f"{c} double, " for c in more) + "mean double, variance double")

    def update(self, fields: DataFrame, width: int) -> DataFrame:
        """Free draws on a grid turned into conditional ones: each takes over the kriged residual of its own values (needs a known mean).

        Observations stand on cells: x is the column, y the row.
        """
        cells = (self.at[:, 1] * width + self.at[:, 0]).astype(int)
        size = len(self.at)

        def more(x: np.ndarray, _) -> np.ndarray:
            n = x.shape[1]
            grid = np.column_stack((np.arange(n) % width, np.arange(n) // width)).astype(float)
            weights = self._cross(grid)[:, :size] @ self.inverse[:size, :size]
            return x + (self.values - x[:, cells]) @ weights.T

        return _mapped(fields, "values", more)


def around_reference(residuals: DataFrame, reference: list[float], sigma: float = 0.0, arithmetic: bool = False) -> DataFrame:
    """Logarithms of reference times 10^residual; arithmetic keeps the arithmetic mean instead of the median."""
    base = np.asarray(reference, float) - (0.5 * math.log(10) * sigma * sigma if arithmetic else 0.0)
    return _mapped(residuals, "values", lambda x, _: base + x)


def perlin(spark: SparkSession, n: int | DataFrame, height: int, width: int, cell: float, seed: int) -> DataFrame:
    """Two-dimensional gradient noise on a lattice of ``cell`` grid steps, with a lattice of its own for each sample."""

    def one(i: int) -> np.ndarray:
        rng = np.random.default_rng([seed, i])
        y, x = np.meshgrid(np.arange(height) / cell + rng.uniform(), np.arange(width) / cell + rng.uniform(), indexing="ij")
        y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
        angle = rng.uniform(0, 2 * math.pi, (y0.max() + 2, x0.max() + 2))
        fade = lambda t: t**3 * (t * (6 * t - 15) + 10)
        v, u = fade(y - y0), fade(x - x0)
        dot = lambda a, b: np.sin(angle[y0 + a, x0 + b]) * (y - y0 - a) + np.cos(angle[y0 + a, x0 + b]) * (x - x0 - b)
        top, bottom = dot(0, 0) * (1 - u) + dot(0, 1) * u, dot(1, 0) * (1 - u) + dot(1, 1) * u
        return top * (1 - v) + bottom * v

    def run(batches):
        for b in batches:
            for i in b.column("id").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([one(i).ravel().tolist()], pa.list_(pa.float64()))], ["sample_id", "values"])

    return samples(spark, n).mapInArrow(run, FIELD)


def spectrum(fields: DataFrame, height: int, width: int) -> DataFrame:
    """sample_id, ring, energy: the Hann-tapered periodogram of centred fields (values), summed by rings of frequency."""

    def run(batches):
        taper = np.outer(np.hanning(height), np.hanning(width))
        fy, fx = np.fft.fftfreq(height) * height, np.fft.fftfreq(width) * width
        ring = np.rint(np.hypot(fy[:, None], fx)).astype(int)
        for b in batches:
            ids, rings, energy = [], [], []
            for i, v in zip(b.column("sample_id").to_pylist(), b.column("values").to_pylist(), strict=True):
                x = np.reshape(v, (height, width))
                power = np.abs(np.fft.fft2((x - x.mean()) * taper)) ** 2
                total = np.bincount(ring.ravel(), power.ravel())
                ids += [i] * len(total)
                rings += range(len(total))
                energy += total.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rings, pa.int32()), pa.array(energy, pa.float64())], ["sample_id", "ring", "energy"])

    return fields.select("sample_id", "values").mapInArrow(run, "sample_id long, ring int, energy double")


def labels(mask: np.ndarray) -> np.ndarray:
    """4-connected components of a boolean array, numbered from 1 in reading order; 0 is outside."""
    out = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        new = out.copy()
        for axis in (0, 1):
            for step in (1, -1):
                moved = np.roll(out, step, axis)
                edge = [slice(None)] * 2
                edge[axis] = 0 if step == 1 else -1
                moved[tuple(edge)] = 0
                new = np.where(mask & (moved > 0), np.minimum(new, moved), new)
        if (new == out).all():
            break
        out = new
    return np.searchsorted(np.unique(out[mask]), out) * mask + mask if mask.any() else out


def components(fields: DataFrame, height: int, width: int, threshold: float) -> DataFrame:
    """sample_id, label, cells, row, col (centroid) of the components of cells at or above a threshold."""

    def run(batches):
        for b in batches:
            rows = []
            for i, v in zip(b.column("sample_id").to_pylist(), b.column("values").to_pylist(), strict=True):
                found = labels(np.reshape(v, (height, width)) >= threshold)
                for k in range(1, int(found.max(initial=0)) + 1):
                    r, c = np.nonzero(found == k)
                    rows.append((i, k, len(r), float(r.mean()), float(c.mean())))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)], ["sample_id", "label", "cells", "row", "col"])

    return fields.select("sample_id", "values").mapInArrow(run, "sample_id long, label int, cells int, row double, col double")
