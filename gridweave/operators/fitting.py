"""Fits of variogram models, cross-validated kriging, likelihood and bootstrap, grouped by Spark."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridweave.operators.distributions import bounded
from gridweave.operators.spatial import block_key, buffered_training
from gridweave.randomfield.fields import Kriging, kernel

FAMILIES = ("exponential", "gaussian", "matern32")
#: Points that are kriged together, about.
PART = 4096


def least_squares(residual, start: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Levenberg and Marquardt with a numeric Jacobian, for a handful of parameters."""
    x, damp, r = np.asarray(start, float), 1e-2, residual(start)
    for _ in range(rounds):
        j = np.column_stack([(residual(x + 1e-6 * e) - r) / 1e-6 for e in np.eye(len(x))])
        a, g = j.T @ j, j.T @ r
        step = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), -g, rcond=None)[0]
        new = residual(x + step)
        if new @ new < r @ r:
            gone = r @ r - new @ new
            x, r, damp = x + step, new, damp / 3
            if gone < 1e-14 * (1 + r @ r):
                break
        else:
            damp *= 4
    return x


def fit_variogram(lag: np.ndarray, gamma: np.ndarray, weight: np.ndarray, family: str) -> dict:
    """nugget, sill and length by weighted least squares in logarithms, and the RMSE."""
    w = np.sqrt(weight / weight.sum())

    def model(p):
        nugget, sill, length = np.exp(np.clip(p, -30, 30))
        return nugget + sill * (1 - kernel(lag / length, family))

    top = max(gamma.max(), 1e-12)
    best = min((least_squares(lambda p: w * (model(p) - gamma), np.log([0.1 * top, 0.9 * top, s * lag.max()])) for s in (0.1, 0.3, 1.0)), key=lambda p: ((w * (model(p) - gamma)) ** 2).sum())
    nugget, sill, length = np.exp(np.clip(best, -30, 30))
    return {"family": family, "nugget": nugget, "sill": sill, "length": length, "rmse": float(np.sqrt(((w * (model(best) - gamma)) ** 2).sum()))}


def variogram_fits(curve: DataFrame, by: str) -> DataFrame:
    """by, family, nugget, sill, length, rmse of a curve (lag, gamma, pairs); each key's few bins are one group."""
    schema = f"{by} string, family string, nugget double, sill double, length double, rmse double"

    def fit(key, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("lag")
        lag, gamma, pairs = (x[c].to_numpy(float) for c in ("lag", "gamma", "pairs"))
        return pd.DataFrame([{by: str(key[0]), **fit_variogram(lag, gamma, pairs, f)} for f in FAMILIES])

    return curve.groupBy(by).applyInPandas(fit, schema)


def block_cross_validation(points: DataFrame, sigma: float, length: float, nugget: float) -> DataFrame:
    """fold, id, truth, mean, std: each fold's points (x_m, y_m, value) kriged from those of the other folds.

    A study's measurements are a bounded set (n by n systems); each fold gets
    them all by a join on its number and is solved in a task of its own.
    """
    folds = points.select(F.col("fold").alias("out")).distinct()
    each = points.join(F.broadcast(folds))
    schema = "fold int, id long, truth double, mean double, std double"

    def solve(key, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("id")
        test, train = x[x["fold"] == key[0]], x[x["fold"] != key[0]]
        model = Kriging.fit(train[["x_m", "y_m"]], train["value"], sigma, length, float(train["value"].mean()), nugget)
        mean, variance = model.predict(test[["x_m", "y_m"]].to_numpy(float))
        return pd.DataFrame({"fold": test["fold"], "id": test["id"], "truth": test["value"], "mean": mean, "std": np.sqrt(variance + nugget)})

    return each.groupBy("out").applyInPandas(solve, schema)


def covariance_scores(points: DataFrame, candidates: list[tuple[float, float, float]]) -> DataFrame:
    """sigma, length, nugget and restricted log likelihood of candidates, one task a candidate."""
    spark = points.sparkSession
    table = spark.createDataFrame(candidates, "sigma double, length double, nugget double")
    each = points.select("id", "x_m", "y_m", "value").join(F.broadcast(table))

    def score(key, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("id")
        return pd.DataFrame([(*key, restricted_likelihood(x[["x_m", "y_m"]].to_numpy(float), x["value"].to_numpy(float), *key))], columns=["sigma", "length", "nugget", "likelihood"])

    return each.groupBy("sigma", "length", "nugget").applyInPandas(score, "sigma double, length double, nugget double, likelihood double")


def restricted_likelihood(at: np.ndarray, y: np.ndarray, sigma: float, length: float, nugget: float) -> float:
    """REML of an exponential model with a constant, unknown mean."""
    n = len(y)
    d = np.hypot(*(at[:, None] - at).transpose(2, 0, 1))
    lower = np.linalg.cholesky(sigma * sigma * np.exp(-d / length) + nugget * np.eye(n))
    white = np.linalg.solve(lower, np.column_stack((np.ones(n), y)))
    one, z = white.T
    beta = (one @ z) / (one @ one)
    r = z - beta * one
    return float(-0.5 * (r @ r + 2 * np.log(np.diag(lower)).sum() + math.log(one @ one) + (n - 1) * math.log(2 * math.pi)))


def _extent() -> list[Column]:
    return [F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("x_m", "y_m"))]


def _side(e, per_block: int) -> float:
    """Side of square blocks that hold about so many points of a table with these numbers (``_extent``)."""
    if not e["n"]:
        return 1.0
    width, height = e["max_x_m"] - e["min_x_m"], e["max_y_m"] - e["min_y_m"]
    whole = max(width, height) + 1.0
    share = per_block / e["n"]
    return whole if share >= 1 else max(math.sqrt(width * height * share), whole * share)


def block_size(points: DataFrame, per_block: int) -> float:
    """Side of square blocks that hold about so many points (x_m, y_m)."""
    return _side(points.agg(*_extent()).first(), per_block)


def universal_prediction(
    at: np.ndarray, y: np.ndarray, noise: np.ndarray, x: np.ndarray, sigma: float, length: float, family: str = "exponential", trend: str = "linear"
) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance at x of a field with a constant or linear trend, whose coefficients are estimated too.

    The variance is that of the noise-free field, with the uncertainty of the
    trend. Coordinates of the trend are centred and scaled. With fewer
    observations than a linear trend needs the trend is constant.
    """
    middle, scale = at.mean(axis=0), max(float(np.abs(at - at.mean(axis=0)).max()), 1e-9)

    def design(p):
        flat = np.ones((len(p), 1))
        return np.column_stack((flat, (p - middle) / scale)) if trend == "linear" and len(at) > 3 else flat

    cov = lambda a, b: sigma * sigma * kernel(np.hypot(a[:, :1] - b[:, 0], a[:, 1:] - b[:, 1]) / length, family)
    lower = np.linalg.cholesky(cov(at, at) + np.diag(noise) + 1e-10 * sigma * sigma * np.eye(len(at)))
    f, z = np.linalg.solve(lower, design(at)), np.linalg.solve(lower, y)
    inner = np.linalg.pinv(f.T @ f, hermitian=True)
    beta = inner @ f.T @ z
    w = np.linalg.solve(lower, cov(at, x))
    rest = design(x) - w.T @ f
    mean = design(x) @ beta + w.T @ (z - f @ beta)
    return mean, np.maximum(sigma * sigma - (w * w).sum(axis=0) + ((rest @ inner) * rest).sum(axis=1), 0)


def _once(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place once, and which of them each row stands at."""
    places, which = np.unique(at, axis=0, return_inverse=True)
    return places, which.ravel()


def _coarser(block: str) -> Column:
    """The number of the block that holds a block (column), of the row's level."""
    return F.floor(F.col(block) / F.pow(F.lit(2.0), F.col("level"))).cast("int")


def local_kriging(
    points: DataFrame, observed: DataFrame, sigma: float = 1.0, length: float = 1.0, mean: float | None = None, nugget: float = 0.0, per_block: int = 40, least: int = 16,
    models: list[dict] | dict[int, list[dict]] | None = None, by: str | None = None,
) -> DataFrame:
    """id, mean, variance of points (id, x_m, y_m), kriged from all observations (x_m, y_m, value) of the blocks around.

    ``models`` (dicts of model, sigma, length, nugget, family, trend) gives a row for each point and model instead, by ``universal_prediction``.
    ``by``, a column of integers in both tables, has each of its values kriged by itself, with blocks of its own, in the same jobs; models are then a dict by them.

    Observations at one place are one with their mean and a part of the
    nugget, which is the same system. A block of points takes the observations
    of its own block and the eight around it; where these are fewer than
    ``least``, sides are doubled until they are enough or hold all. A few
    hundred observations are one block: the whole system.
    """
    apart = [by] if by else []
    places = observed.groupBy(*apart, "x_m", "y_m").agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    extent = lambda x: {r[by] if by else None: r for r in x.groupBy(*apart).agg(*_extent()).collect()}
    held, asked = extent(places), extent(points)
    sides = {k: _side(r, per_block if r["n"] > 9 * per_block else max(r["n"], 1)) for k, r in held.items()}

    def told(of: dict, missing):
        """A number of each table kriged by itself, as a column."""
        if not by:
            return F.lit(of.get(None, missing))
        return F.coalesce(F.create_map(*(F.lit(x) for k, v in of.items() for x in (k, v)))[F.col(by)], F.lit(missing)) if of else F.lit(missing)

    block = {b: F.floor(F.col(c) / told(sides, 1.0)).cast("int") for b, c in (("bx", "x_m"), ("by", "y_m"))}
    own, train = points.select(*apart, "id", "x_m", "y_m").withColumns(block), places.withColumns(block)
    wanted, counts = own.select(*apart, "bx", "by").distinct(), train.groupBy(*apart, "bx", "by").agg(F.count("*").alias("n"))
    # Levels are as many as doublings reach over all blocks of either table.
    ends = [abs(r[f"{f}_{c}"] / sides.get(k, 1.0)) for x in (held, asked) for k, r in x.items() for f in ("min", "max") for c in ("x_m", "y_m") if r[f"{f}_{c}"] is not None]
    top = math.ceil(math.log2(max(map(math.floor, ends), default=0) + 3))

    def spread(x: DataFrame, levels: list[int], *columns: str) -> DataFrame:
        """Rows of blocks in all neighbourhoods (level, cx, cy) that they are in."""
        around = F.array(*(F.struct(F.lit(k).alias("level"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k in levels for i in (-1, 0, 1) for j in (-1, 0, 1)))
        out = x.withColumn("o", F.explode(around)).withColumn("level", F.col("o.level"))
        return out.select(*apart, *columns, "level", *((_coarser(b) + F.col(f"o.{o}")).alias(c) for b, o, c in (("bx", "i", "cx"), ("by", "j", "cy"))))

    near = spread(counts, list(range(top + 1)), "n").groupBy(*apart, "level", "cx", "cy").agg(F.sum("n").alias("found"))
    tried = wanted.withColumn("level", F.explode(F.array(*map(F.lit, range(top + 1))))).withColumns({"cx": _coarser("bx"), "cy": _coarser("by")})
    enough = (F.col("level") >= top) | (F.coalesce("found", F.lit(0)) >= F.least(F.lit(least), told({k: r["n"] for k, r in held.items()}, 0)))
    placed = tried.join(near, [*apart, "level", "cx", "cy"], "left").where(enough).groupBy(*apart, "bx", "by").agg(F.min("level").alias("level"))
    placed = placed.withColumns({"cx": _coarser("bx"), "cy": _coarser("by")})
    used = spread(train, sorted(r[0] for r in placed.select("level").distinct().collect()), "x_m", "y_m", "value", "n")
    # Targets of one neighbourhood are dealt to parts, each of which gets its few observations.
    near_by = [*apart, "level", "cx", "cy"]
    keys = [*near_by, "part"]
    each = own.join(placed, [*apart, "bx", "by"])
    share = each.groupBy(*near_by).agg((F.floor(F.count("*") / PART) + 1).cast("int").alias("parts"))
    targets = each.join(share, near_by).select("id", "x_m", "y_m", *near_by, F.pmod(F.xxhash64("id", "x_m", "y_m"), F.col("parts")).cast("int").alias("part"))
    dealt = share.select(*near_by, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    used = used.join(dealt, near_by)
    used = used.select(*(F.col(c).alias(c if c == "n" else f"_{c}") for c in used.columns))

    names = [*(["model"] if models else []), *apart, "id", "mean", "variance"]
    schema = ("model string, " if models else "") + (f"{by} int, " if by else "") + "id long, mean double, variance double"

    def several(key, x: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        at, y, n, to = seen[["_x_m", "_y_m"]].to_numpy(float), seen["_value"].to_numpy(float), seen["n"].to_numpy(float), x[["x_m", "y_m"]].to_numpy(float)
        to, same = _once(to)
        out = []
        for m in models[key[0]] if by else models:
            found = [universal_prediction(at, y, m["nugget"] / n, to[k : k + 4096], m["sigma"], m["length"], m["family"], m["trend"]) for k in range(0, len(to), 4096)]
            mean, variance = (np.concatenate([f[c] for f in found])[same] for c in (0, 1))
            out.append(pd.DataFrame({"model": m["model"], **({by: key[0]} if by else {}), "id": x["id"].to_numpy(), "mean": mean, "variance": variance}))
        return pd.concat(out)

    def solve(key, x: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or models and not len(seen):
            return pd.DataFrame({c: [] for c in names})
        if not len(seen):
            return pd.DataFrame({"id": x["id"], "mean": mean, "variance": sigma * sigma if mean is not None else None})
        seen = seen.sort_values(["_x_m", "_y_m"])
        if models:
            return several(key, x, seen)
        model = Kriging.fit(seen[["_x_m", "_y_m"]], seen["_value"], sigma, length, mean, nugget / seen["n"].to_numpy(float))
        at, same = _once(x[["x_m", "y_m"]].to_numpy(float))
        parts = [model.predict(at[k : k + 4096]) for k in range(0, len(at), 4096)]
        return pd.DataFrame({"id": x["id"], "mean": np.concatenate([m for m, _ in parts])[same], "variance": np.concatenate([v for _, v in parts])[same]})

    return targets.groupBy(*keys).cogroup(used.groupBy(*(f"_{k}" for k in keys))).applyInPandas(solve, schema)


def model_cross_validation(folded: DataFrame, folds: int, models: list[dict], size: float, buffer_m: float = 0.0) -> DataFrame:
    """model, fold, block, id, truth, mean, std of points (id, x_m, y_m, value, bx, by, fold) by each model.

    A fold is kriged from the points of the others that stand at least
    ``buffer_m`` from its blocks. The standard deviation is that of a reading.
    """
    out, noise = None, F.create_map(*(F.lit(x) for m in models for x in (m["model"], float(m["nugget"]))))
    for k in range(folds):
        test = folded.where(F.col("fold") == k)
        train = folded.where(F.col("fold") != k)
        if buffer_m > 0:
            train = buffered_training(train.drop("bx", "by"), test.select("bx", "by").distinct(), size, buffer_m)
        found = local_kriging(test, train, models=models).join(test.select("id", "fold", "bx", "by", F.col("value").alias("truth")), "id")
        found = found.select("model", "fold", F.concat_ws("/", "bx", "by").alias("block"), "id", "truth", "mean", F.sqrt(F.col("variance") + noise[F.col("model")]).alias("std"))
        out = found if out is None else out.unionByName(found)
    return out


def reml_search(points: DataFrame, rounds: int = 4) -> DataFrame:
    """sigma, length, nugget, likelihood: the best of a grid of candidates that is refined about the best so far.

    All 27 candidates of a round are scored in one job, block by block; only
    their likelihoods pass the driver.
    """
    e = points.agg(F.stddev_samp("value").alias("sd"), F.max("x_m") - F.min("x_m"), F.max("y_m") - F.min("y_m")).first()
    sd, extent = e[0] or 1.0, max(e[1] or 0, e[2] or 0, 1.0)
    at, step, best = (sd, extent / 10, 0.1 * sd * sd), 4.0, None
    for _ in range(rounds):
        candidates = [(at[0] * a, at[1] * b, at[2] * c) for a in (1 / step, 1.0, step) for b in (1 / step, 1.0, step) for c in (1 / step, 1.0, step)]
        found = block_covariance_scores(points, candidates).collect()
        best = max([*found, *([best] if best else [])], key=lambda r: r["likelihood"])
        at, step = (best["sigma"], best["length"], best["nugget"]), math.sqrt(step)
    return points.sparkSession.createDataFrame([(*at, best["likelihood"])], "sigma double, length double, nugget double, likelihood double")


def mean_correlation(height: int, width: int, along: float, across: float, angle: float) -> float:
    """The mean Matern-3/2 correlation of two cells of a grid, both taken at random."""
    i, j = np.arange(1 - height, height), np.arange(1 - width, width)
    weight = np.outer(height - np.abs(i), width - np.abs(j)) / (height * width) ** 2
    return float((weight * kernel(rotated_lag(i[:, None], j[None], along, across, angle), "matern32")).sum())


def rotated_lag(dy, dx, along: float, across: float, angle: float):
    """Lags in units of the two lengths, of which the first lies at an angle from the x axis."""
    u, v = dx * np.cos(angle) + dy * np.sin(angle), dy * np.cos(angle) - dx * np.sin(angle)
    return np.hypot(u / along, v / across)


def structural_fit(curve: DataFrame, variance: float, height: int, width: int) -> DataFrame:
    """nugget, sill, along, across, angle, rmse of a curve (dy, dx, gamma, pairs): a rotated anisotropic Matern-3/2 model.

    Fitted in logarithms of the semivariance. A finite domain shows less than
    the sill: the variance seen is nugget + sill * (1 - mean correlation).
    Lengths end at four sides of the grid. A curve has a few bins a direction, which pass the driver.
    """
    rows = curve.where("gamma > 0").collect()
    dy, dx, gamma, pairs = (np.array([float(r[c]) for r in rows]) for c in ("dy", "dx", "gamma", "pairs"))
    weight = np.sqrt(pairs / pairs.sum())

    def parts(p):
        share, along, across = 1 / (1 + math.exp(-np.clip(p[0], -30, 30))), *np.exp(np.clip(p[1:3], math.log(0.1), math.log(4 * max(height, width))))
        sill = variance * (1 - share) / max(1 - mean_correlation(height, width, along, across, p[3]), 1e-6)
        return variance * share, sill, along, across

    def residual(p):
        nugget, sill, along, across = parts(p)
        return weight * (np.log(nugget + sill * (1 - kernel(rotated_lag(dy, dx, along, across, p[3]), "matern32")) + 1e-12) - np.log(gamma))

    starts = [[s, math.log(a), math.log(b), t] for s in (-3.0, 0.0) for a, b in ((2.0, 2.0), (4.0, 1.5)) for t in (0.0, math.pi / 4, math.pi / 2, 3 * math.pi / 4)]
    best = min((least_squares(residual, np.array(x)) for x in starts), key=lambda p: float(residual(p) @ residual(p)))
    nugget, sill, along, across = parts(best)
    angle = best[3]
    if along < across:
        along, across, angle = across, along, angle + math.pi / 2
    row = (nugget, sill, along, across, float(angle % math.pi), float(np.sqrt(residual(best) @ residual(best))))
    return curve.sparkSession.createDataFrame([tuple(map(float, row))], "nugget double, sill double, along double, across double, angle double, rmse double")


def block_condition(points: DataFrame, length: float, per_block: int = 200) -> DataFrame:
    """bx, by, n, condition of the correlation matrices of blocks of about so many points; repeated places count once.

    Kriging solves systems of this size, so these are the numbers that tell
    whether it can. Up to nine blocks' points are one block: the whole matrix.
    """
    places = points.select("x_m", "y_m").distinct()
    count = places.count()
    keyed = block_key(places, block_size(places, per_block if count > 9 * per_block else max(count, 1)), *(places.agg(F.min("x_m"), F.min("y_m")).first() if count else (0.0, 0.0)))

    def run(key, x: pd.DataFrame) -> pd.DataFrame:
        at = x.sort_values(["x_m", "y_m"])[["x_m", "y_m"]].to_numpy(float)
        value = np.linalg.eigvalsh(np.exp(-np.hypot(at[:, :1] - at[:, 0], at[:, 1:] - at[:, 1]) / length))
        return pd.DataFrame([(*key, len(at), float(value[-1] / max(value[0], 1e-12 * value[-1])))], columns=["bx", "by", "n", "condition"])

    return keyed.groupBy("bx", "by").applyInPandas(run, "bx int, by int, n long, condition double")


def local_cross_validation(points: DataFrame, folds: int, sigma: float, length: float, nugget: float) -> DataFrame:
    """fold, id, truth, mean, std as of block_cross_validation, for tables of any size: folds are kriged in blocks."""
    points, out = points.select("fold", "id", "x_m", "y_m", "value"), None
    for k in range(folds):
        test, train = points.where(F.col("fold") == k), points.where(F.col("fold") != k)
        known = train.agg(F.avg("value").alias("m")).first()["m"]
        if known is None:
            continue
        found = local_kriging(test, train, sigma, length, known, nugget).join(test, "id")
        found = found.select("fold", "id", F.col("value").alias("truth"), "mean", F.sqrt(F.col("variance") + nugget).alias("std"))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else points.select("fold", "id", F.col("value").alias("truth"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("std"))


def block_covariance_scores(points: DataFrame, candidates: list[tuple[float, float, float]], per_block: int = 200) -> DataFrame:
    """As covariance_scores, summed over blocks of about so many points, each with a mean of its own.

    Up to nine blocks' points are one block: the likelihood of the whole.
    """
    count = points.count()
    keyed = block_key(points, block_size(points, per_block if count > 9 * per_block else max(count, 1)), *(points.agg(F.min("x_m"), F.min("y_m")).first() if count else (0.0, 0.0)))
    table = points.sparkSession.createDataFrame(candidates, "sigma double, length double, nugget double")
    each = keyed.select("id", "x_m", "y_m", "value", "bx", "by").join(F.broadcast(table))

    def score(key, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("id")
        found = restricted_likelihood(x[["x_m", "y_m"]].to_numpy(float), x["value"].to_numpy(float), *key[:3])
        return pd.DataFrame([(*key[:3], found)], columns=["sigma", "length", "nugget", "likelihood"])

    blocks = each.groupBy("sigma", "length", "nugget", "bx", "by").applyInPandas(score, "sigma double, length double, nugget double, likelihood double")
    return blocks.groupBy("sigma", "length", "nugget").agg(F.sum("likelihood").alias("likelihood"))


def block_bootstrap(blocks: DataFrame, replicates: int, seed: int) -> DataFrame:
    """estimate, lower, upper (95 %) of the mean difference over blocks (block, value), resampled by seeded hashes.

    Each replicate's picks come from hashes of (replicate, place), and blocks
    are looked up by their place; their table is sent to every task after a
    check of its size.
    """
    spark = blocks.sparkSession
    placed = bounded(blocks.where("value is not null").select("value", (F.row_number().over(W.orderBy("block")) - 1).cast("int").alias("pick")))
    n, mean = placed.agg(F.count("*"), F.avg("value")).first()
    picks = spark.range(replicates).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))).alias("place"))
    pick = F.pmod(F.xxhash64("replicate", "place", F.lit(seed)), F.lit(max(n, 1))).cast("int")
    means = picks.select("replicate", pick.alias("pick")).join(placed, "pick").groupBy("replicate").agg(F.avg("value").alias("m"))
    out = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return out.select(F.lit(mean).cast("double").alias("estimate"), F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))
