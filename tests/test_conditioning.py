"""Nested conditioning and continuous expansions against dense computations."""
import numpy as np
import pytest
from gridweave.operators.conditioning import NestedConditioner
from gridweave.randomfield.continuous import ContinuousExpansion
from gridweave.randomfield.fields import Expansion, kernel

AT = [(0, 0), (7, 8), (0, 8), (7, 0), (4, 4), (2, 6), (6, 2)]
VALUES = np.linspace(-9.6, -9.1, len(AT))


@pytest.fixture(scope="module")
def readings(spark):
    return spark.createDataFrame([(k + 1, r, c, float(v)) for k, ((r, c), v) in enumerate(zip(AT, VALUES))], "place int, row int, col int, value double")


@pytest.fixture(scope="module")
def prior():
    return np.random.default_rng(3).standard_normal((3, 8, 9))


@pytest.fixture(scope="module")
def fields(spark, prior):
    return spark.createDataFrame([(s, r, c, float(prior[s, r, c])) for s in range(3) for r in range(8) for c in range(9)], "sample_id long, row int, col int, value double")


def dense(n):
    """Weights of all cells for the first n readings, and their variances, by a solve of their own."""
    cells, at = np.array([(r, c) for r in range(8) for c in range(9)], float), np.array(AT[:n], float)
    cov = lambda a, b: 0.04 * kernel(np.hypot(*(a[:, None] - b).transpose(2, 0, 1)) / 4.0, "matern32")
    cross = cov(cells, at)
    weights = np.linalg.solve(cov(at, at), cross.T).T
    return weights, 0.04 - (weights * cross).sum(axis=1)


def test_all_prefixes_equal_separate_solves(readings, fields, prior):
    found = NestedConditioner.fit(readings, -9.3, 0.2, 4.0)
    counts = [1, 2, 3, 5, 7]
    got = {(r.readings, r.row, r.col): (r.mean, r.std) for r in found.moments(fields.select("row", "col").distinct(), counts).collect()}
    drawn = {(r.readings, r.sample_id, r.row, r.col): r.value for r in found.draws(fields.repartition(5), counts).collect()}
    assert len(got) == 5 * 72 and len(drawn) == 5 * 3 * 72
    for n in counts:
        weights, variance = dense(n)
        mean = -9.3 + weights @ (VALUES[:n] + 9.3)
        for k in range(72):
            r, c = divmod(k, 9)
            assert got[n, r, c] == pytest.approx((mean[k], np.sqrt(max(variance[k], 0))), abs=1e-7)
            for s in range(3):
                own = np.array([-9.3 + 0.2 * prior[s, a, b] for a, b in AT[:n]])
                want = -9.3 + 0.2 * prior[s, r, c] + weights[k] @ (VALUES[:n] - own)
                assert abs(drawn[n, s, r, c] - want) < 1e-9
        for (r, c), v in zip(AT[:n], VALUES):
            assert all(abs(drawn[n, s, r, c] - v) < 1e-9 for s in range(3))


def test_unknown_mean_equals_ordinary_systems(readings, fields, prior):
    """Each prefix against a system with a multiplier of its own."""
    found = NestedConditioner.fit(readings, None, 0.2, 4.0)
    counts = [1, 2, 4, 7]
    got = {(r.readings, r.row, r.col): (r.mean, r.std) for r in found.moments(fields.select("row", "col").distinct(), counts).collect()}
    drawn = {(r.readings, r.sample_id, r.row, r.col): r.value for r in found.draws(fields.repartition(3), counts).collect()}
    cov = lambda a, b: 0.04 * kernel(np.hypot(*(a[:, None] - b).transpose(2, 0, 1)) / 4.0, "matern32")
    cells = np.array([(r, c) for r in range(8) for c in range(9)], float)
    for n in counts:
        at = np.array(AT[:n], float)
        system = np.block([[cov(at, at), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
        right = np.vstack((cov(cells, at).T, np.ones(72)))
        solved = np.linalg.solve(system, right)
        variance = 0.04 - (solved * right).sum(axis=0)
        for k in range(72):
            r, c = divmod(k, 9)
            assert got[n, r, c] == pytest.approx((solved[:n, k] @ VALUES[:n], np.sqrt(max(variance[k], 0))), abs=1e-7)
            for s in range(3):
                own = np.array([0.2 * prior[s, a, b] for a, b in AT[:n]])
                assert abs(drawn[n, s, r, c] - (0.2 * prior[s, r, c] + solved[:n, k] @ (VALUES[:n] - own))) < 1e-9


def test_tiles_share_one_result(spark, readings, monkeypatch):
    z = np.random.default_rng(4).standard_normal((2, 70, 9))
    wide = spark.createDataFrame([(s, r, c, float(z[s, r, c])) for s in range(2) for r in range(70) for c in range(9)], "sample_id long, row int, col int, value double")
    found = NestedConditioner.fit(readings, -9.3, 0.2, 4.0)
    got = found.draws(wide, [7])
    assert got.count() == 2 * 630
    at = {(r.sample_id, r.row, r.col): r.value for r in got.where("row in (0, 2, 7)").collect()}
    assert all(abs(at[s, r, c] - v) < 1e-9 for s in range(2) for (r, c), v in zip(AT, VALUES) if r in (0, 2, 7))


def test_odd_input_is_refused(spark, readings, fields):
    found = NestedConditioner.fit(readings, -9.3, 0.2, 4.0)
    for counts in ([], [2, 1], [0, 3], [1, 8], [1, 1]):
        with pytest.raises(ValueError, match="increase"):
            found.moments(fields, counts)
    with pytest.raises(ValueError, match="distinct"):
        NestedConditioner.fit(readings.union(readings.selectExpr("place + 10", "row", "col", "value")), -9.3, 0.2, 4.0)
    with pytest.raises(ValueError, match="readings"):
        NestedConditioner.fit(readings.where("place < 0"), -9.3, 0.2, 4.0)
    with pytest.raises(Exception, match="non-finite"):
        found.draws(fields.selectExpr("sample_id", "row", "col", "case when row = 3 and col = 3 then double('nan') else value end as value"), [1]).collect()
    with pytest.raises(Exception, match="missing"):
        found.draws(fields.where("not (row = 7 and col = 8)"), [1]).collect()
    assert found.draws(fields.where("false"), [1]).collect() == []


@pytest.mark.parametrize("family", ["exponential", "gaussian", "matern32"])
def test_continuous_modes_equal_the_grid_at_its_centres(family):
    grid = Expansion.fit(6, 9, -9.3, 0.4, 3.0, family)
    found = ContinuousExpansion.fit(6, 9, 5.0, -9.3, 0.4, 15.0, family)
    y, x = ((np.indices((6, 9)).reshape(2, -1)) + 0.5) * 5.0
    assert np.abs(found.basis(x, y) - grid.basis).max() < 1e-8
    assert np.isnan(found.basis(np.array([-1.0, 5.0]), np.array([5.0, 31.0]))).all()


def test_draws_between_the_cells(spark):
    found = ContinuousExpansion.fit(6, 9, 5.0, -9.3, 0.4, 15.0)
    rng = np.random.default_rng(2)
    at, xi = rng.uniform(0, 30, (40, 2)), rng.standard_normal((3, found.size + 2))
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(at)] + [(40, 46.0, 1.0)], "id long, x_m double, y_m double")
    draws = spark.createDataFrame([(s, v.tolist()) for s, v in enumerate(xi)], "sample_id long, xi array<double>")
    got = {(r.id, r.sample_id): r.value for r in found.draws_at(points, draws).collect()}
    want = -9.3 + found.basis(at[:, 0], at[:, 1]) @ xi[:, : found.size].T
    assert all(abs(got[k, s] - want[k, s]) < 1e-12 for k in range(40) for s in range(3)) and got[40, 0] is None
    with pytest.raises(ValueError, match="coordinates"):
        found.draws_at(points, draws.selectExpr("sample_id", "slice(xi, 1, 2) as xi"))


def test_posterior_at_points_equals_a_dense_one(spark):
    found = ContinuousExpansion.fit(6, 9, 5.0, -9.3, 0.4, 15.0, share=0.99)
    rng = np.random.default_rng(5)
    at, to, noise = rng.uniform(0, 30, (25, 2)), rng.uniform(0, 30, (10, 2)), 0.1
    value = rng.normal(-9.2, 0.4, 25)
    schema = "id long, x_m double, y_m double, value double"
    seen = [(k, float(x), float(y), float(v)) for k, ((x, y), v) in enumerate(zip(at, value))]
    readings = spark.createDataFrame([*seen, (90, 99.0, 1.0, -9.0), (91, 3.0, 3.0, None), (92, 3.0, 3.0, float("nan"))], schema).repartition(4)
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(to)], "id long, x_m double, y_m double")
    a, b = found.basis(at[:, 0], at[:, 1]), found.basis(to[:, 0], to[:, 1])
    c = a @ a.T + noise**2 * np.eye(25)
    mean = -9.3 + b @ a.T @ np.linalg.solve(c, value + 9.3)
    variance = (b * b).sum(axis=1) - ((b @ a.T) * np.linalg.solve(c, a @ b.T).T).sum(axis=1)
    for r in found.posterior_at(points, readings, noise).collect():
        assert (r.mean, r.std) == pytest.approx((mean[r.id], np.sqrt(variance[r.id])), abs=1e-9)
    d = found.diagnostics(readings, noise).first()
    assert d.readings == 25 and d.chi2 == pytest.approx((value + 9.3) @ np.linalg.solve(c, value + 9.3), rel=1e-9)
    assert d.mean_squared_score == pytest.approx((((value + 9.3) ** 2) / np.diag(c)).mean(), rel=1e-9)
    prior = found.prior_at(points).collect()
    assert all(r.mean == -9.3 and r.std == pytest.approx(np.sqrt((b[r.id] ** 2).sum())) for r in prior)
    with pytest.raises(ValueError, match="noise"):
        found.posterior(readings, 0.0)


def test_truncations_equal_fields_of_their_own(spark):
    from gridweave.operators.truncation import partial_quantities, truncation_table

    found = ContinuousExpansion.fit(4, 5, 5.0, -9.3, 0.4, 15.0, share=0.999)
    xi = np.random.default_rng(6).standard_normal((30, found.size))
    y, x = (np.indices((4, 5)).reshape(2, -1) + 0.5) * 5.0
    basis, terms = found.basis(x, y), [1, 3, found.size]
    draws = spark.createDataFrame([(s, v.tolist()) for s, v in enumerate(xi)], "sample_id long, xi array<double>")
    rows = {(r.quantity, r.terms): r for r in truncation_table(partial_quantities(found, draws, terms, -9.2)).collect()}
    full = -9.3 + xi @ basis.T
    for n in terms:
        field = -9.3 + xi[:, :n] @ basis[:, :n].T
        for name, f in (("mean", lambda a: a.mean(axis=1)), ("highest", lambda a: a.max(axis=1)), ("above", lambda a: (a > -9.2).mean(axis=1))):
            a, r = f(field), rows[name, n]
            want = (a.mean(), a.std(ddof=1), *np.quantile(a, [0.05, 0.5, 0.95]), np.sqrt(((a - f(full)) ** 2).mean()))
            assert (r["mean"], r["std"], r["q05"], r["q50"], r["q95"], r["paired_rmse"]) == pytest.approx(want, abs=1e-9)
    with pytest.raises(ValueError, match="increase"):
        partial_quantities(found, draws, [3, 1], 0.0)


def test_noisy_readings_are_met_within_their_noise(spark, readings, fields):
    found = NestedConditioner.fit(readings, -9.3, 0.2, 4.0, noise=0.05)
    got = [found.draws(fields.repartition(n), [7], seed=2).collect() for n in (1, 4)]
    assert sorted(got[0]) == sorted(got[1])
    at = {(r.sample_id, r.row, r.col): r.value for r in got[0]}
    gaps = [at[s, r, c] - v for s in range(3) for (r, c), v in zip(AT, VALUES)]
    assert 1e-4 < np.abs(gaps).mean() < 0.15
