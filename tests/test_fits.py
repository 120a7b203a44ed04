"""Fits, nearest neighbours, pairs and ranks against plain computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.operators import distributions as D, fitting as X, spatial as P, summaries as Y
from gridweave.randomfield.fields import kernel
from gridweave.streaming import accumulators as A


def table(spark, at, value):
    return spark.createDataFrame([(i, float(x), float(y), float(z)) for i, ((x, y), z) in enumerate(zip(at, value, strict=True))], "id long, x_m double, y_m double, value double")


@pytest.mark.parametrize("trend, family", [("linear", "exponential"), ("constant", "matern32"), ("linear", "gaussian")])
def test_universal_prediction_solves_the_saddle_point_system(trend, family):
    rng = np.random.default_rng(4)
    at, to = rng.uniform(0, 100, (30, 2)), rng.uniform(0, 100, (7, 2))
    y, noise = 2 + 0.3 * at[:, 0] + rng.normal(size=30), rng.uniform(0.05, 0.2, 30)
    f = lambda p: np.column_stack((np.ones(len(p)), p)) if trend == "linear" else np.ones((len(p), 1))
    cov = lambda a, b: 0.64 * kernel(np.hypot(a[:, :1] - b[:, 0], a[:, 1:] - b[:, 1]) / 25, family)
    k = f(at).shape[1]
    whole = np.block([[cov(at, at) + np.diag(noise), f(at)], [f(at).T, np.zeros((k, k))]])
    right = np.vstack((cov(at, to), f(to).T))
    weights = np.linalg.solve(whole, right)
    mean, variance = X.universal_prediction(at, y, noise, to, 0.8, 25, family, trend)
    assert mean == pytest.approx(weights[:30].T @ y, rel=1e-6) and variance == pytest.approx(0.64 - (weights * right).sum(axis=0), abs=1e-6)


def test_models_of_a_small_table_are_the_whole_system(spark):
    rng = np.random.default_rng(5)
    at = rng.uniform(0, 3000, (80, 2))
    value = 1e-3 * at[:, 0] + np.sin(at[:, 1] / 400)
    models = [{"model": t, "sigma": 0.7, "length": 600.0, "nugget": 0.05, "family": "exponential", "trend": t} for t in ("constant", "linear")]
    df = table(spark, at, value)
    got = X.local_kriging(df, df, models=models).collect()
    for t in ("constant", "linear"):
        mean, variance = X.universal_prediction(at, value, np.full(80, 0.05), at, 0.7, 600.0, "exponential", t)
        own = {r.id: r for r in got if r.model == t}
        assert len(own) == 80 and all(own[i].mean == pytest.approx(mean[i], abs=1e-8) and own[i].variance == pytest.approx(variance[i], abs=1e-8) for i in own)


def test_buffered_folds(spark):
    rng = np.random.default_rng(6)
    at = rng.uniform(0, 3000, (90, 2))
    value = np.cos(at[:, 0] / 500)
    df = P.block_key(table(spark, at, value), 1000.0).withColumn("fold", (F.col("bx") + F.col("by")) % 3)
    model = {"model": "m", "sigma": 0.7, "length": 600.0, "nugget": 0.05, "family": "exponential", "trend": "constant"}
    got = {r.id: r for r in X.model_cross_validation(df, 3, [model], 1000.0, 150.0).collect()}
    assert len(got) == 90
    b = np.floor(at / 1000)
    fold = (b.sum(axis=1) % 3).astype(int)
    for k in range(3):
        test = np.nonzero(fold == k)[0]
        corners = np.unique(b[test], axis=0) * 1000
        inside = lambda p: any((c[0] - 150 <= p[0] < c[0] + 1150) and (c[1] - 150 <= p[1] < c[1] + 1150) for c in corners)  # noqa: B023, E731
        train = [i for i in range(90) if fold[i] != k and not inside(at[i])]
        mean, variance = X.universal_prediction(at[train], value[train], np.full(len(train), 0.05), at[test], 0.7, 600.0, "exponential", "constant")
        for i, m, s in zip(test.tolist(), mean, np.sqrt(variance + 0.05), strict=True):
            assert (got[i].fold, got[i].mean, got[i].std) == (k, pytest.approx(m, abs=1e-7), pytest.approx(s, abs=1e-7))


def test_search_finds_a_better_likelihood_than_its_neighbours(spark):
    rng = np.random.default_rng(7)
    at = rng.uniform(0, 1000, (120, 2))
    c = 0.5 * np.exp(-np.hypot(at[:, :1] - at[:, 0], at[:, 1:] - at[:, 1]) / 150) + 0.05 * np.eye(120)
    y = np.linalg.cholesky(c) @ rng.normal(size=120)
    r = X.reml_search(table(spark, at, y)).first()
    assert r.likelihood == pytest.approx(X.restricted_likelihood(at, y, r.sigma, r.length, r.nugget), abs=1e-6)
    assert r.likelihood > X.restricted_likelihood(at, y, 0.5**0.5, 150.0, 0.05) - 0.3


def test_structural_fit_recovers_a_rotated_model(spark):
    rows, share = [], 1 - X.mean_correlation(40, 40, 8.0, 3.0, 0.6)
    for dy, dx in ((1, 0), (0, 1), (1, 1), (1, -1), (1, 2), (2, 1)):
        for k in range(1, 8):
            gamma = 0.1 + 2.0 * (1 - kernel(X.rotated_lag(k * dy, k * dx, 8.0, 3.0, 0.6), "matern32"))
            rows.append((float(k * dy), float(k * dx), float(gamma), 100))
    curve = spark.createDataFrame(rows, "dy double, dx double, gamma double, pairs long")
    r = X.structural_fit(curve, 0.1 + 2.0 * share, 40, 40).first()
    assert (r.nugget, r.sill, r.along, r.across, r.angle) == (pytest.approx(0.1, abs=0.02), pytest.approx(2.0, rel=0.02), pytest.approx(8.0, rel=0.02), pytest.approx(3.0, rel=0.02), pytest.approx(0.6, abs=0.02))


def test_nearest_distance(spark):
    rng = np.random.default_rng(8)
    train, test = np.concatenate((rng.uniform(0, 100, (200, 2)), rng.normal(50, 0.1, (300, 2)))), np.concatenate((rng.uniform(-50, 150, (60, 2)), [[9000.0, -4000.0]]))
    t, q = table(spark, train, np.zeros(500)), table(spark, test, np.zeros(61))
    q = q.union(spark.createDataFrame([(900, None, 3.0, 0.0)], q.schema))
    t = t.union(spark.createDataFrame([(901, 1.0, None, 0.0)], t.schema))
    got = {r.id: r.distance for r in P.nearest_distance(q, t).collect()}
    want = np.hypot(test[:, :1] - train[:, 0], test[:, 1:] - train[:, 1]).min(axis=1)
    assert got.pop(900) is None and len(got) == 61 and all(got[i] == pytest.approx(want[i], rel=1e-12) for i in got)
    assert P.nearest_distance(q, t.where("false")).count() == 0


def test_pairs_in_blocks(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(23, 3, 4))
    rows = [(i, r, c, float(x[i, r, c])) for i in range(23) for r in range(3) for c in range(4) if (i, r, c) != (5, 1, 1)] + [(40, 9, 9, 1.0), (41, 0, 0, None)]
    f = spark.createDataFrame(rows, "sample_id long, row int, col int, value double")
    got = {(r.a, r.b): r.rms for r in D.pairwise_rms(f, block=4).collect()}
    known = {(i, r, c): v for i, r, c, v in rows if v is not None}
    for a in range(23):
        for b in range(a + 1, 23):
            d = [known[a, r, c] - known[b, r, c] for r in range(3) for c in range(4) if (a, r, c) in known and (b, r, c) in known]
            assert got.pop((a, b)) == pytest.approx(math.sqrt(sum(v * v for v in d) / len(d)), rel=1e-9)
    assert not got


@pytest.mark.parametrize("n", [1, 7, 5000])
def test_order_statistics(spark, n):
    values = np.random.default_rng(n).integers(0, max(2, n // 3), n).astype(float)
    df = spark.createDataFrame([(float(v),) for v in values], "value double")
    for rank in {1, (n + 1) // 2, n}:
        assert spark.range(1).select(Y.order_statistic(df, rank)).first()[0] == np.sort(values)[rank - 1]


def test_libraries_are_checked(spark):
    with pytest.raises(ValueError):
        D.bounded(spark.range(11), 10)
    assert D.bounded(spark.range(10), 10).count() == 10


def test_merged_batches_are_one_pass(spark):
    x = np.random.default_rng(3).normal(5, 1, 60)
    rows = [(k // 7, 0, 0, float(v)) for k, v in enumerate(x)]
    parts = None
    for k in range(9):
        one = A.partials(spark.createDataFrame([r[1:] for r in rows if r[0] == k], "row int, col int, value double"))
        parts = one if parts is None else parts.unionByName(one)
    r = A.merged(parts).first()
    assert (r["count"], r.mean, r.variance) == (60, pytest.approx(x.mean()), pytest.approx(x.var(ddof=1)))
