"""Restricted likelihood by gradient from several starts, and cross-validation that refits in every fold.

A block of points adds its own likelihood and exact gradient to the sums over
all blocks. All runs (a start of a model in a fold) go on together: each step
is one job, in which every block answers for the trial parameters of every
run, so its points are read and its distances are made once a step. What
passes the driver is four numbers for each trial.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from gridweave.operators.fitting import block_size, local_kriging
from gridweave.operators.spatial import block_key
from gridweave.randomfield.fields import kernel

#: What the kernels k of lags r gain by a larger logarithm of the length.
STRETCH = {"exponential": lambda r, k: r * k, "gaussian": lambda r, k: r * r * k, "matern32": lambda r, k: 3 * r * r * k / (1 + math.sqrt(3) * r)}
#: Shares of a step that are tried in the same job.
TRIALS = (1.0, 0.25, 0.03)
#: Partitions of the blocks, whose rows are few beside what they cost.
_SPREAD = 48


def trend_basis(at: np.ndarray, trend: str, count: np.ndarray | None = None) -> np.ndarray:
    """An orthonormal basis of the trend's columns at points, or at places with so many readings each; columns that others give leave it."""
    flat, root = np.ones((len(at), 1)), np.ones(len(at)) if count is None else np.sqrt(count)
    if trend == "linear":
        moved = at - np.average(at, axis=0, weights=root * root)
        flat = np.column_stack((flat, moved / max(float(np.abs(moved).max(initial=0)), 1e-9)))
    elif trend != "constant":
        raise ValueError(f"no trend is named {trend}")
    left, size, _ = np.linalg.svd(flat * root[:, None], full_matrices=False)
    return left[:, size > 1e-9 * size[0]] / root[:, None]


def unmixing(lower: np.ndarray) -> np.ndarray:
    """The inverses of a stack of lower triangles, by halves: products of matrices do most of it."""
    n = lower.shape[-1]
    if n <= 16:
        return np.linalg.inv(lower)
    m, out = n // 2, np.zeros_like(lower)
    out[..., :m, :m], out[..., m:, m:] = unmixing(lower[..., :m, :m]), unmixing(lower[..., m:, m:])
    out[..., m:, :m] = -out[..., m:, m:] @ (lower[..., m:, :m] @ out[..., :m, :m])
    return out


def restricted(
    distance: np.ndarray, y: np.ndarray, basis: np.ndarray, logs: np.ndarray, family: str, count: np.ndarray | None = None, within: float = 0.0
) -> tuple[np.ndarray, np.ndarray]:
    """Negative restricted log likelihood and its gradient by the logarithms of length, sigma and the nugget's deviation.

    logs may be a stack of parameters, whose values and gradients are stacks too.
    Readings at one place are their mean: count has their numbers, within their
    sum of squares about the means, and the likelihood is that of all readings.
    """
    length, sigma, tau = (x[..., None, None] for x in np.moveaxis(np.exp(logs), -1, 0))
    share = np.ones(len(y)) if count is None else 1 / count
    total = len(y) if count is None else float(count.sum())
    lag = distance / length
    near = kernel(lag, family)
    shape = sigma * sigma * near
    lower = np.linalg.cholesky(shape + tau * tau * np.diag(share))
    unmixed = unmixing(lower)
    q, upper = np.linalg.qr(unmixed @ basis)
    # What is left of whitened data without the trend.
    white = unmixed @ y
    residual = white - (q @ (np.swapaxes(q, -1, -2) @ white[..., None]))[..., 0]
    logged = lambda x: np.log(np.abs(np.diagonal(x, axis1=-2, axis2=-1))).sum(axis=-1)
    value = 0.5 * (residual * residual).sum(axis=-1) + logged(lower) + logged(upper) + 0.5 * (total - basis.shape[1]) * math.log(2 * math.pi)
    value = value + (total - len(y)) * np.log(tau[..., 0, 0]) + 0.5 * (0.0 if count is None else np.log(count).sum()) + 0.5 * within / tau[..., 0, 0] ** 2
    turned = np.swapaxes(unmixed, -1, -2)
    lost = turned @ np.concatenate((q, residual[..., None]), axis=-1)
    inner = turned @ unmixed - lost @ np.swapaxes(lost, -1, -2)
    both = lambda d: np.einsum("...ij,...ij->...", inner, d)
    square, noise = sigma[..., 0, 0] ** 2, tau[..., 0, 0] ** 2
    parts = (square * both(STRETCH[family](lag, near)), 2 * both(shape), 2 * noise * (np.diagonal(inner, axis1=-2, axis2=-1) * share).sum(axis=-1))
    gradient = np.stack([0.5 * p for p in parts], axis=-1)
    gradient[..., 2] += total - len(y) - within / noise
    return (float(value) if np.ndim(logs) == 1 else value), gradient


@dataclass
class Descent:
    """Projected quasi-Newton descent that is asked for trial points and told their values and gradients."""

    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    limit: int = 40
    value: float = math.inf
    gradient: np.ndarray | None = None
    curve: np.ndarray | None = None
    steps: int = 0
    status: str = ""
    error: str = ""
    asked: list = field(default_factory=list)

    def __post_init__(self) -> None:
        self.at = np.clip(self.at, self.low, self.high)

    def free(self) -> np.ndarray:
        """The gradient without what leads out of the bounds."""
        out = ((self.at <= self.low) & (self.gradient > 0)) | ((self.at >= self.high) & (self.gradient < 0))
        return np.where(out, 0, self.gradient)

    def ask(self) -> list[np.ndarray]:
        if self.status:
            self.asked = []
        elif self.gradient is None:
            self.asked = [self.at]
        else:
            g = self.free()
            way = -(self.curve @ g) * (g != 0)
            if way @ g >= 0:
                self.curve = np.eye(len(g)) / max(1.0, float(np.abs(g).max()))
                way = -(self.curve @ g)
            way *= min(1.0, 2.0 / max(float(np.abs(way).max()), 1e-300))
            self.asked = [np.clip(self.at + t * way, self.low, self.high) for t in TRIALS]
        return self.asked

    def tell(self, values: list[float], gradients: list[np.ndarray], error: str = "") -> None:
        if self.status:
            return
        k = int(np.argmin(values))
        if not math.isfinite(values[k]) and self.gradient is None:
            self.status, self.error = "failed", error or "the likelihood is not finite"
            return
        gone = self.value - values[k]
        if self.gradient is None:
            self.curve = np.eye(len(self.at)) / max(1.0, float(np.abs(gradients[k]).max()))
        elif not gone > 0:
            self.status = "converged" if np.abs(self.free()).max() < 1e-3 * max(1.0, abs(self.value)) else "stalled"
            return
        else:
            s, y = self.asked[k] - self.at, gradients[k] - self.gradient
            if s @ y > 1e-12:
                one = np.eye(len(s)) - np.outer(s, y) / (s @ y)
                self.curve = one @ self.curve @ one.T + np.outer(s, s) / (s @ y)
        self.at, self.value, self.gradient, self.steps = self.asked[k], values[k], gradients[k], self.steps + 1
        if np.abs(self.free()).max() < 1e-6 * max(1.0, abs(self.value)) or gone < 1e-7 * abs(self.value):
            self.status = "converged"
        elif self.steps >= self.limit:
            self.status = "limit"


def keyed_blocks(points: DataFrame, per_block: int) -> DataFrame:
    """Points with block_x, block_y of blocks that hold about so many places, however many points share one; a smaller table is one block."""
    low = points.agg(F.min("x_m"), F.min("y_m")).first()
    return block_key(points, block_size(points.select("x_m", "y_m").distinct(), per_block), low[0] or 0.0, low[1] or 0.0).withColumnsRenamed({"bx": "block_x", "by": "block_y"})


def gathered(keyed: DataFrame) -> DataFrame:
    """Readings (value) of a place and the same ``held`` as one row: their number n, mean, and sum of squares about it."""
    return keyed.groupBy("block_x", "block_y", "x_m", "y_m", "held").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("*")).alias("within"))


#: Numbers of a stack of systems that are solved at once, about.
STACK = 1_000_000


def objectives(keyed: DataFrame, asked: list[tuple]) -> dict[int, tuple]:
    """By number of asked (number, fold, family, trend, logs): value, gradient, readings, error of the sums over blocks.

    keyed has readings (value) or is what ``gathered`` makes of them. A point
    trains a fold unless ``held`` (an array of folds) has it. A block is as
    large as its places are many, not as its readings, and all parameters
    of a model for the same readings go in one stack.
    """
    named = "number int, value double, g0 double, g1 double, g2 double, n long, error string"

    def training(x: pd.DataFrame, kept: np.ndarray) -> tuple:
        """Places, distances, means, numbers and squares of the rows kept; rows of one place are one."""
        at, first = np.unique(x.loc[kept, ["x_m", "y_m"]].to_numpy(float), axis=0, return_inverse=True)
        n, mean, within = (x.loc[kept, c].to_numpy(float) for c in ("n", "mean", "within"))
        first = first.ravel()
        count = np.bincount(first, n, len(at))
        middle = np.bincount(first, n * mean, len(at)) / count
        squares = within.sum() + (n * (mean - middle[first]) ** 2).sum()
        return at, np.hypot(at[:, :1] - at[:, 0], at[:, 1:] - at[:, 1]), middle, count, float(squares)

    def block(x: pd.DataFrame) -> pd.DataFrame:
        rows, known, stacks = [], {}, {}
        for number, fold, family, trend, logs in asked:
            if fold not in known:
                known[fold] = np.array([fold is None or fold not in set(h) for h in x["held"]], bool).tobytes()
            stacks.setdefault((known[fold], family, trend), []).append((number, logs))
        data = {}
        for (mask, family, trend), own in stacks.items():
            kept = np.frombuffer(mask, bool)
            if not kept.any():
                continue
            if mask not in data:
                data[mask] = training(x, kept)
            at, distance, y, count, within = data[mask]
            n = int(count.sum())
            step = max(1, STACK // len(at) ** 2)
            parts = [own[k : k + step] for k in range(0, len(own), step)]
            while parts:
                part = parts.pop()
                try:
                    basis, logs = trend_basis(at, trend, count), np.array([p for _, p in part])
                    value, gradient = restricted(distance, y, basis, logs, family, count, within) if n > basis.shape[1] else (np.zeros(len(part)), np.zeros((len(part), 3)))
                    if not np.isfinite(value).all():
                        raise ArithmeticError("the likelihood is not finite")
                    rows += [(number, float(v), *g, n, None) for (number, _), v, g in zip(part, value, gradient.tolist(), strict=True)]
                except (ArithmeticError, ValueError, np.linalg.LinAlgError) as why:
                    # One that fails is found by itself; the others of its stack go on.
                    if len(part) > 1:
                        parts += [[p] for p in part]
                    else:
                        rows.append((part[0][0], 0.0, 0.0, 0.0, 0.0, n, f"{type(why).__name__}: {why}"))
        return pd.DataFrame(rows, columns=["number", "value", "g0", "g1", "g2", "n", "error"])

    x = keyed if "within" in keyed.columns else gathered(keyed)
    found = x.groupBy("block_x", "block_y").applyInPandas(block, named).groupBy("number")
    out = found.agg(*(F.sum(c).alias(c) for c in ("value", "g0", "g1", "g2", "n")), F.min("error").alias("error")).collect()
    return {r["number"]: (math.inf if r["error"] else r["value"], np.array([r["g0"], r["g1"], r["g2"]]), r["n"], r["error"] or "") for r in out}


def descended(keyed: DataFrame, runs: list[tuple], low: np.ndarray, high: np.ndarray, limit: int = 40, least: int = 2) -> list[tuple[Descent, int]]:
    """The descents of all runs (fold, family, trend, start in logarithms), with how many readings each has; one job a step for all."""
    going = [Descent(np.asarray(start, float), low, high, limit) for *_, start in runs]
    readings = [0] * len(runs)
    while True:
        asked, owner = [], []
        for k, (run, (fold, family, trend, _)) in enumerate(zip(going, runs, strict=True)):
            for x in run.ask():
                asked.append((len(asked), fold, family, trend, x))
                owner.append(k)
        if not asked:
            return list(zip(going, readings, strict=True))
        found = objectives(keyed, asked)
        for k, run in enumerate(going):
            own = [found.get(n, (math.inf, np.zeros(3), 0, "no readings")) for n, o in enumerate(owner) if o == k]
            if own:
                readings[k] = max(readings[k], own[0][2])
                if readings[k] < least:
                    run.status, run.error = "failed", f"{readings[k]} readings are fewer than {least}"
                else:
                    run.tell([v for v, *_ in own], [g for _, g, *_ in own], next((e for *_, e in own if e), ""))


def limits(points: DataFrame) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Deviation and extent of points, and bounds of the logarithms of length, sigma and the nugget's deviation."""
    e = points.agg(F.stddev_samp("value").alias("sd"), (F.max("x_m") - F.min("x_m")).alias("w"), (F.max("y_m") - F.min("y_m")).alias("h")).first()
    sd, extent = e["sd"] if e["sd"] and math.isfinite(e["sd"]) else 1.0, max(e["w"] or 0.0, e["h"] or 0.0, 1.0)
    return sd, extent, np.log([extent / 500, sd / 100, sd / 100]), np.log([2 * extent, 10 * sd, 10 * sd])


def _starts(sd: float, extent: float, shares) -> list[np.ndarray]:
    return [np.log([s * extent, 0.8 * sd, 0.5 * sd]) for s in shares]


def reml(points: DataFrame, family: str = "exponential", trend: str = "constant", per_block: int = 200, shares=(0.02, 0.08, 0.3)) -> DataFrame:
    """start, length, sigma, nugget (a variance), objective, gradient, steps, status, at_bound, best: a row for each start.

    points: x_m, y_m, value, of which null and non-finite values take no part.
    Each block has a trend of its own, and the sum over blocks is what is
    descended: blocks are of one size whatever the table's.
    """
    used = points.select("x_m", "y_m", "value", F.array().cast("array<int>").alias("held")).where("value is not null and not isnan(value) and abs(value) < double('inf')")
    sd, extent, low, high = limits(used)
    keyed = gathered(keyed_blocks(used, per_block)).repartition(_SPREAD, "block_x", "block_y").persist()
    try:
        starts = _starts(sd, extent, shares)
        found = descended(keyed, [(None, family, trend, s) for s in starts], low, high)
    finally:
        keyed.unpersist()
    top = min(found, key=lambda f: f[0].value)[0]
    rows = []
    for share, (run, _) in zip(shares, found, strict=True):
        length, sigma, tau = np.exp(run.at).tolist()
        edge = bool((np.minimum(run.at - low, high - run.at) < 0.01).any())
        steepest = float(np.abs(run.free()).max()) if run.gradient is not None else None
        rows.append((float(share), length, sigma, tau * tau, run.value if math.isfinite(run.value) else None, steepest, run.steps, run.status, run.error or None, edge, run is top and run.status != "failed"))
    return points.sparkSession.createDataFrame(
        rows, "start double, length double, sigma double, nugget double, objective double, gradient double, steps int, status string, error string, at_bound boolean, best boolean"
    )


def held_folds(folded: DataFrame, size: float, buffer_m: float) -> DataFrame:
    """Points (id, x_m, y_m, bx, by, fold, ...) with held, the folds that they must not train: those with a block within the buffer, their own too."""
    reach = math.ceil(buffer_m / size)
    around = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    near = folded.select("id", "x_m", "y_m", "bx", "by", F.explode(F.array(*around)).alias("o"))
    near = near.select("id", "x_m", "y_m", (F.col("bx") + F.col("o.i")).alias("bx"), (F.col("by") + F.col("o.j")).alias("by"))
    blocks = folded.select("bx", "by", F.col("fold").alias("other")).distinct()
    touch = lambda v, b: (F.col(v) >= F.col(b) * size - buffer_m) & (F.col(v) < (F.col(b) + 1) * size + buffer_m)
    held = near.join(blocks, ["bx", "by"]).where(touch("x_m", "bx") & touch("y_m", "by")).groupBy("id").agg(F.sort_array(F.collect_set(F.col("other").cast("int"))).alias("held"))
    return folded.join(held, "id")


def refitted_folds(folded: DataFrame, folds: int, models: list[dict], size: float, buffer_m: float = 0.0, per_block: int = 100, least: int = 20, shares=(0.05, 0.25), limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """Fits and predictions of models (model, family, trend), fitted anew without each fold and its buffer.

    folded: id (unique), x_m, y_m, value, bx, by, fold (0 up). The first table
    has a row for each model and fold with its parameters and its status: a
    fit that fails is a row with its error, and the others go on. The second
    has model, fold, block, id, truth, mean, std of the fits that succeeded.
    """
    spark = folded.sparkSession
    points = held_folds(folded, size, buffer_m).persist()
    fits, fitted, out = [], {}, None
    try:
        sd, extent, low, high = limits(points)
        keyed = gathered(keyed_blocks(points.select("x_m", "y_m", "value", "held"), per_block)).repartition(_SPREAD, "block_x", "block_y").persist()
        runs = [(k, m, s) for k in range(folds) for m in models for s in _starts(sd, extent, shares)]
        found = descended(keyed, [(k, m["family"], m["trend"], s) for k, m, s in runs], low, high, limit, least)
        keyed.unpersist()
        for k in range(folds):
            known = []
            for m in models:
                own = [f for (fold, model, _), f in zip(runs, found, strict=True) if fold == k and model is m]
                run, n = min(own, key=lambda f: f[0].value)
                length, sigma, tau = np.exp(run.at).tolist()
                failed = run.status == "failed"
                fits.append((m["model"], k, run.status, run.error or None, int(n), *((None,) * 4 if failed else (length, sigma, tau * tau, run.value))))
                if not failed:
                    known.append({**m, "length": length, "sigma": sigma, "nugget": tau * tau})
            if known:
                fitted[k] = known
        if fitted:
            test = points.where(F.col("fold").isin(*fitted))
            others = F.explode(F.array_except(F.array(*map(F.lit, fitted)), F.col("held"))).alias("fold")
            noise = F.create_map(*(F.lit(x) for k, known in fitted.items() for m in known for x in (f"{k}/{m['model']}", m["nugget"])))
            out = local_kriging(test, points.select("x_m", "y_m", "value", others), models=fitted, by="fold").join(test.select("id", "fold", "bx", "by", F.col("value").alias("truth")), ["id", "fold"])
            std = F.sqrt(F.col("variance") + noise[F.concat_ws("/", "fold", "model")]).alias("std")
            out = out.select("model", F.col("fold").cast("int").alias("fold"), F.concat_ws("/", "bx", "by").alias("block"), "id", "truth", "mean", std)
    finally:
        points.unpersist()
    table = spark.createDataFrame(fits, "model string, fold int, status string, error string, readings long, length double, sigma double, nugget double, objective double")
    empty = "model string, fold int, block string, id long, truth double, mean double, std double"
    return table, out if out is not None else spark.createDataFrame([], empty)


def chosen(scores: DataFrame, fits: DataFrame) -> str | None:
    """The model without a failed fold that has the least score (model, block, crps), each block with the same weight."""
    whole = fits.groupBy("model").agg(F.bool_or(F.col("status") == "failed").alias("failed")).where("not failed")
    best = scores.groupBy("model", "block").agg(F.avg("crps").alias("crps")).groupBy("model").agg(F.avg("crps").alias("crps"))
    return best.join(whole, "model", "left_semi").select(F.min_by("model", F.struct("crps", "model"))).first()[0]


def scored_folds(fits: DataFrame, scored: DataFrame) -> DataFrame:
    """fits with n, rmse, crps of their fold from scored (model, fold, block, e, crps), and whether ``chosen`` takes their model.

    Predictions are read once: they are summed up by block, and folds and
    models are made of these sums.
    """
    blocks = scored.groupBy("model", "fold", "block").agg(F.count("*").alias("n"), F.sum(F.col("e") * F.col("e")).alias("squares"), F.count("e").alias("known"), F.sum("crps").alias("total"), F.count("crps").alias("m"))
    own = F.col("total") / F.nullif("m", F.lit(0))
    sums = [F.sum("n").alias("n"), F.sqrt(F.sum("squares") / F.nullif(F.sum("known"), F.lit(0))).alias("rmse"), (F.sum("total") / F.nullif(F.sum("m"), F.lit(0))).alias("crps"), F.sum(own).alias("_own"), F.count(own).alias("_blocks")]
    out = fits.join(blocks.groupBy("model", "fold").agg(*sums), ["model", "fold"], "left")
    model = W.partitionBy("model")
    score = F.sum("_own").over(model) / F.nullif(F.sum("_blocks").over(model), F.lit(0))
    out = out.withColumns({"_score": score, "_whole": ~F.bool_or(F.col("status") == "failed").over(model) & (F.count("n").over(model) > 0)})
    # A row for each model and fold stands in this window, whatever the table's size.
    best = F.min(F.when(F.col("_whole"), F.struct("_score", "model"))).over(W.partitionBy())
    return out.withColumn("chosen", F.col("model") == best["model"]).drop("_own", "_blocks", "_score", "_whole")
