"""Reconstruction by readings and structural scenarios against dense computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.operators.conditioning import NestedConditioner
from gridweave.operators.ranks import quantile, ranked, running
from gridweave.operators.reconstruction import reconstruction_cases, reconstruction_errors, stopping_counts
from gridweave.operators.scenarios import scenario_mixture, scenario_quantities, scenario_table
from gridweave.operators.summaries import binomial_ranks
from gridweave.randomfield.continuous import ContinuousExpansion
from gridweave.randomfield.fields import kernel

AT = [(0, 0), (4, 5), (0, 5), (4, 0), (2, 3)]


def test_ranks_by_key(spark):
    rng = np.random.default_rng(1)
    each = {0: rng.normal(0, 1, 900), 1: np.round(rng.normal(5, 1, 80), 1), 2: np.array([3.0])}
    df = spark.createDataFrame([(k, float(x), 1) for k, v in each.items() for x in v], "k int, value double, n int").repartition(4)
    got = {r.k: r for r in running(df, ["n"], 16, ("k",)).groupBy("k").agg(ranked(1).alias("a"), ranked(40).alias("b"), quantile(0.3).alias("q"), ranked(None).alias("z")).collect()}
    for k, v in each.items():
        v = np.sort(v)
        assert got[k].a == v[0] and got[k].b == (v[39] if len(v) > 39 else None) and got[k].q == pytest.approx(np.quantile(v, 0.3)) and got[k].z is None


def test_reconstruction_against_dense_systems(spark):
    rng = np.random.default_rng(9)
    reference, prior = rng.normal(-1, 0.4, (5, 6)), rng.standard_normal((60, 5, 6))
    rows = [(k, r, c, float(reference[r, c])) for k, (r, c) in enumerate(AT)]
    found = NestedConditioner.fit(spark.createDataFrame(rows, "place int, row int, col int, value double"), None, 1.0, 2.5)
    fields = spark.createDataFrame([(s, r, c, float(prior[s, r, c])) for s in range(60) for r in range(5) for c in range(6)], "sample_id long, row int, col int, value double").repartition(4)
    truth = spark.createDataFrame([(r, c, float(reference[r, c])) for r in range(5) for c in range(6)], "row int, col int, reference double")
    counts, sigmas = [1, 3, 5], [0.1, 0.5]
    errors = reconstruction_errors(found, fields, truth, counts, sigmas)
    got = {(r.readings, r.sigma, r.sample_id): (r.error, r.spread) for r in errors.collect()}
    assert len(got) == 3 * 2 * 60
    cells, want = np.array([(r, c) for r in range(5) for c in range(6)], float), {}
    cov = lambda a, b: kernel(np.hypot(*(a[:, None] - b).transpose(2, 0, 1)) / 2.5, "matern32")
    for n in counts:
        at = np.array(AT[:n], float)
        system = np.block([[cov(at, at), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
        weights = np.linalg.solve(system, np.vstack((cov(cells, at).T, np.ones(30))))[:n].T
        own = np.ravel_multi_index(np.array(AT[:n]).T, (5, 6))
        mean = weights @ reference.ravel()[own]
        for sigma in sigmas:
            drawn = sigma * prior.reshape(60, 30)
            conditioned = mean + drawn - drawn[:, own] @ weights.T
            assert np.allclose(conditioned[:, own], reference.ravel()[own])
            error, spread = np.sqrt(((conditioned - reference.ravel()) ** 2).mean(axis=1)), np.sqrt(((conditioned - mean) ** 2).mean(axis=1))
            want[n, sigma] = (error, spread)
            for s in range(60):
                assert got[n, sigma, s] == pytest.approx((error[s], spread[s]), abs=1e-9)
    low, high = binomial_ranks(60, 0.8, 0.9)
    cases = reconstruction_cases(errors, 0.8, 0.9)
    rows = cases.collect()
    assert len(rows) == 12
    table = {}
    for r in rows:
        x = np.sort(want[r.readings, r.sigma][0 if r.quantity == "error" else 1])
        assert (r.draws, r.estimate, r.lower, r.upper) == (60, pytest.approx(x[47]), pytest.approx(x[low - 1]), pytest.approx(x[high - 1]))
        assert r.mean_square == pytest.approx((x * x).mean()) and r.markov_bound >= r.estimate
        table[r.quantity, r.sigma, r.readings] = (x[47], x[high - 1])
    for r in stopping_counts(cases, [0.05, 0.3, 0.45]).collect():
        fewest = lambda k: min((n for n in counts if table[r.quantity, r.sigma, n][k] <= r.limit), default=None)
        assert (r.by_estimate, r.by_upper) == (fewest(0), fewest(1))
    with pytest.raises(ValueError):
        reconstruction_errors(NestedConditioner.fit(spark.createDataFrame([(0, 0, 0, 1.0)], "place int, row int, col int, value double"), 0.0, 1.0, 2.5), fields, truth, [1], [0.1])


def test_scenarios_share_coordinates(spark):
    xi = np.random.default_rng(3).standard_normal((50, 40))
    df = spark.createDataFrame([(s, xi[s].tolist()) for s in range(50)], "sample_id long, xi array<double>").repartition(3)
    found = {f"{f} {n:g}": ContinuousExpansion.fit(5, 6, 100.0, -0.5, 0.3, n, f, 0.9) for f in ("matern32", "exponential") for n in (200.0, 600.0)}
    table = scenario_table(scenario_quantities(found, df, -0.3), [20, 50])
    got = {(r.scenario, r.draws, r.quantity): r for r in table.collect()}
    assert len(got) == 4 * 2 * 3
    y, x = (np.indices((5, 6)).reshape(2, -1) + 0.5) * 100
    plain = {}
    for name, e in found.items():
        field = -0.5 + xi[:, : e.size] @ e.basis(x, y).T
        for q, value in (("mean", field.mean(axis=1)), ("highest", field.max(axis=1)), ("above", (field > -0.3).mean(axis=1))):
            for n in (20, 50):
                r = got[name, n, q]
                plain[name, n, q] = value[:n].mean(), value[:n].var(ddof=1)
                assert r.n == n and (r.average, r.variance) == pytest.approx(plain[name, n, q])
    assert len({round(got[n, 50, "mean"].variance, 9) for n in found}) == 4  # family and length matter
    weights = dict(zip(found, (0.4, 0.3, 0.2, 0.1)))
    for r in scenario_mixture(table, weights).collect():
        means, variances = (np.array([plain[n, r.draws, r.quantity][k] for n in found]) for k in (0, 1))
        w = np.array(list(weights.values()))
        assert (r.average, r.within, r.between) == pytest.approx((w @ means, w @ variances, w @ (means - w @ means) ** 2), abs=1e-12)
    with pytest.raises(ValueError):
        scenario_mixture(table, {"a": 0.5})
    assert scenario_table(scenario_quantities(found, df.limit(0), 0.0), [5]).count() == 0
