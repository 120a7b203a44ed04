"""Restricted likelihood, its gradient and descent, and refitted folds against dense computations."""
import math

import numpy as np
import pytest
from gridweave.operators import likelihood as L, spatial as P
from gridweave.operators.fitting import local_kriging
from gridweave.randomfield.fields import kernel
from pyspark.sql import functions as F


def drawn(n=90, seed=8, length=500.0):
    rng = np.random.default_rng(seed)
    at = rng.uniform(0, 3000, (n, 2))
    c = 0.36 * kernel(np.hypot(at[:, :1] - at[:, 0], at[:, 1:] - at[:, 1]) / length, "exponential") + 0.01 * np.eye(n)
    return at, -2 + np.linalg.cholesky(c) @ rng.standard_normal(n)


def table(spark, at, value):
    return spark.createDataFrame([(i, float(x), float(y), None if z is None else float(z)) for i, ((x, y), z) in enumerate(zip(at, value))], "id long, x_m double, y_m double, value double")


@pytest.mark.parametrize("family", ["exponential", "gaussian", "matern32"])
@pytest.mark.parametrize("trend", ["constant", "linear"])
def test_likelihood_and_gradient_equal_dense_ones(family, trend):
    rng = np.random.default_rng(21)
    at, y = rng.uniform(0, 7000, (24, 2)), rng.normal(-2.4, 0.5, 24)
    d, basis, logs = np.hypot(at[:, :1] - at[:, 0], at[:, 1:] - at[:, 1]), L.trend_basis(at, trend), np.log([1400.0, 0.5, 0.25])
    value, gradient = L.restricted(d, y, basis, logs, family)
    f = lambda p: L.restricted(d, y, basis, p, family)[0]
    numeric = [(f(logs + 1e-5 * e) - f(logs - 1e-5 * e)) / 2e-5 for e in np.eye(3)]
    assert gradient == pytest.approx(numeric, rel=2e-5, abs=2e-6)
    inverse = np.linalg.inv(0.25 * kernel(d / 1400, family) + 0.0625 * np.eye(24))
    info = basis.T @ inverse @ basis
    r = y - basis @ np.linalg.solve(info, basis.T @ inverse @ y)
    k = basis.shape[1]
    want = 0.5 * (r @ inverse @ r - np.linalg.slogdet(inverse)[1] + np.linalg.slogdet(info)[1] + (24 - k) * math.log(2 * math.pi))
    assert value == pytest.approx(want, abs=1e-9)


def test_sums_over_blocks_and_folds(spark):
    at, y = drawn(60)
    held = [[i % 3] for i in range(60)]
    df = spark.createDataFrame([(float(a), float(b), float(v), h) for (a, b), v, h in zip(at, y, held)], "x_m double, y_m double, value double, held array<int>")
    keyed = P.block_key(df, 1500.0).withColumnsRenamed({"bx": "block_x", "by": "block_y"})
    logs = np.log([700.0, 0.6, 0.2])
    got = L.objectives(keyed, [(0, None, "exponential", "constant", logs), (1, 2, "matern32", "linear", logs), (2, None, "exponential", "constant", np.array([0.0, 900.0, 0.0]))])
    for number, fold, family, trend in ((0, None, "exponential", "constant"), (1, 2, "matern32", "linear")):
        value, gradient, n = 0.0, np.zeros(3), 0
        for b in {tuple(x) for x in np.floor(at / 1500).astype(int)}:
            own = np.array([i for i in range(60) if tuple(np.floor(at[i] / 1500).astype(int)) == b and (fold is None or i % 3 != fold)])
            p = at[own]
            one = L.restricted(np.hypot(p[:, :1] - p[:, 0], p[:, 1:] - p[:, 1]), y[own], L.trend_basis(p, trend), logs, family)
            value, gradient, n = value + one[0], gradient + one[1], n + len(own)
        assert got[number][0] == pytest.approx(value) and got[number][1] == pytest.approx(gradient) and got[number][2] == n
    assert got[2][0] == math.inf and got[2][3]


def test_descent_beats_a_grid_from_every_start(spark):
    at, y = drawn(120)
    found = L.reml(table(spark, [*at, (1.0, 1.0), (2.0, 2.0)], [*y, None, float("nan")]), per_block=500).collect()
    d, basis = np.hypot(at[:, :1] - at[:, 0], at[:, 1:] - at[:, 1]), np.ones((120, 1)) / math.sqrt(120)
    f = lambda p: L.restricted(d, y, basis, np.log(p), "exponential")[0]
    grid = min(f((a, b, c)) for a in np.geomspace(60, 3000, 6) for b in np.geomspace(0.1, 3, 6) for c in np.geomspace(0.01, 1, 6))
    assert [r.status for r in found] == ["converged"] * 3 and sum(r.best for r in found) == 1
    for r in found:
        assert r.objective <= grid + 1e-6 and r.objective == pytest.approx(f((r.length, r.sigma, math.sqrt(r.nugget))), abs=1e-6)
        assert r.gradient < 0.05


def test_no_points(spark):
    rows = L.reml(table(spark, [], [])).collect()
    assert {r.status for r in rows} == {"failed"} and not any(r.best for r in rows)


def folded(spark, at, y):
    return P.block_key(table(spark, at, y), 1000.0).withColumn("fold", ((F.col("bx") + F.col("by")) % 3).cast("int"))


def test_folds_are_fitted_without_their_buffer(spark):
    at, y = drawn(100)
    models = [{"model": t, "family": "exponential", "trend": t} for t in ("constant", "linear")]
    df = folded(spark, at, y)
    fits, found = L.refitted_folds(df, 3, models, 1000.0, 150.0, per_block=500)
    rows = {(r.model, r.fold): r for r in fits.collect()}
    assert len(rows) == 6 and {r.status for r in rows.values()} <= {"converged", "stalled", "limit"}
    b = np.floor(at / 1000)
    fold = (b.sum(axis=1) % 3).astype(int)
    predicted = {(r.model, r.id): r for r in found.collect()}
    assert len(predicted) == 200
    for k in range(3):
        corners = np.unique(b[fold == k], axis=0) * 1000
        inside = [any((c[0] - 150 <= p[0] < c[0] + 1150) and (c[1] - 150 <= p[1] < c[1] + 1150) for c in corners) for p in at]
        train = [i for i in range(100) if not inside[i]]
        r = rows["constant", k]
        assert r.readings == len(train)
        p = at[train]
        own = L.restricted(np.hypot(p[:, :1] - p[:, 0], p[:, 1:] - p[:, 1]), y[train], L.trend_basis(p, "constant"), np.log([r.length, r.sigma, math.sqrt(r.nugget)]), "exponential")
        assert own[0] == pytest.approx(r.objective, abs=1e-6)
        known = table(spark, at, y).where(F.col("id").isin(train))
        again = local_kriging(df.where(F.col("fold") == k), known, models=[{**models[0], "sigma": r.sigma, "length": r.length, "nugget": r.nugget}]).collect()
        assert all(predicted["constant", x.id].mean == pytest.approx(x.mean, abs=1e-9) for x in again) and len(again) == int((fold == k).sum())


def test_failed_fits_are_rows(spark):
    at, y = drawn(40)
    values = [float("inf") if i == 7 else v for i, v in enumerate(y)]
    models = [{"model": "m", "family": "exponential", "trend": "constant"}, {"model": "odd", "family": "exponential", "trend": "cubic"}]
    df = folded(spark, at, values)
    fits, found = L.refitted_folds(df, 3, models, 1000.0, per_block=500, least=5)
    rows = {(r.model, r.fold): r for r in fits.collect()}
    own = int(sum(np.floor(at[7] / 1000)) % 3)
    assert all((rows["m", k].status == "failed") == (k != own) for k in range(3)) and all("trend" in rows["odd", k].error for k in range(3))
    assert {r.fold for r in found.collect()} == {own} and L.chosen(found.selectExpr("model", "block", "abs(mean - truth) as crps"), fits) is None
    few, none = L.refitted_folds(df, 3, models[:1], 1000.0, least=1000)
    assert all("fewer" in r.error for r in few.collect()) and none.count() == 0


def test_many_points_of_one_neighbourhood_go_to_many_groups(spark):
    at, y = drawn(30)
    many = spark.range(20_000).select("id", (F.col("id") % 200 * 15.0).alias("x_m"), (F.floor(F.col("id") / 200) * 30.0).alias("y_m"))
    got = local_kriging(many, table(spark, at, y), 0.6, 500.0, mean=-2.0, nugget=0.01)
    parts = got.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in parts) == 20_000
    one = got.where("id = 777").first()
    c = lambda a, b: 0.36 * kernel(np.hypot(a[:, :1] - b[:, 0], a[:, 1:] - b[:, 1]) / 500, "exponential")
    to = np.array([[777 % 200 * 15.0, 777 // 200 * 30.0]])
    assert one["mean"] == pytest.approx(float(-2 + (c(to, at) @ np.linalg.solve(c(at, at) + 0.01 * np.eye(30), y + 2))[0]), abs=1e-9)
