"""Pooled ranks, target and training comparisons, and rasters at points, against plain computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.operators import compatibility as K, ranks as R
from gridweave.operators.raster import raster_samples


def test_ranks_in_stretches(spark):
    rng = np.random.default_rng(5)
    x, y = np.round(rng.normal(0, 1, 1500), 2), np.round(rng.normal(0.3, 2, 700), 2)
    x[:500], y[3] = 0.25, 1e12  # a third is one value; one outlier
    rows = [(float(a), 1, 0) for a in x] + [(float(a), 0, 1) for a in y] + [(None, 1, 0), (float("nan"), 1, 1)]
    df = spark.createDataFrame(rows, "value double, x int, y int").repartition(5)
    for stretches in (1, 2, 64):
        found = R.running(df, ["x", "y"], stretches)
        got = found.agg(R.distance("x", "y").alias("w1"), *(R.quantile(p, c).alias(f"{c}{k}") for c in "xy" for k, p in enumerate((0, 0.05, 0.5, 0.937, 1)))).first()
        for c, values in (("x", x), ("y", y)):
            assert [got[f"{c}{k}"] for k in range(5)] == pytest.approx(np.quantile(values, (0, 0.05, 0.5, 0.937, 1)).tolist())
        both = np.sort(np.concatenate((x, y)))
        gap = np.abs(np.searchsorted(np.sort(x), both[:-1], "right") / 1500 - np.searchsorted(np.sort(y), both[:-1], "right") / 700)
        assert got["w1"] == pytest.approx(float((gap * np.diff(both)).sum()), rel=1e-12)
        steps = found.orderBy("value").collect()
        assert [r.next for r in steps[:-1]] == [r.value for r in steps[1:]] and steps[-1].next is None
    one = spark.createDataFrame([(2.0, 1, 0), (2.0, 1, 0)], "value double, x int, y int")
    got = R.running(one, ["x", "y"]).agg(R.distance("x", "y").alias("w"), R.distance("x", "x").alias("same"), R.quantile(0.3, "x").alias("q")).first()
    assert got.w is None and got.same == 0 and got.q == 2
    assert R.running(one.limit(0), ["x"]).agg(R.quantile(0.5, "x").alias("q")).first().q is None


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(8)
    a = rng.normal(-9.3, 0.15, (14, 6, 5))
    return a + np.cumsum(rng.normal(0, 0.05, (14, 6, 5)), axis=1)


@pytest.fixture(scope="module")
def fields(spark, values):
    rows = [(s, r, c, float(values[s, r, c])) for s in range(14) for r in range(6) for c in range(5)]
    return spark.createDataFrame(rows, "sample_id long, row int, col int, value double").repartition(3)


def test_marginal_report(spark, fields, values):
    odd = spark.createDataFrame([(90, 0, 0, None), (91, 0, 0, float("nan")), (92, 0, 0, -9.0)], "sample_id long, row int, col int, value double")
    got = {r.sample_id: r for r in K.marginal_report(fields.unionByName(odd), -9.3, 0.2, -9.5, -9.1, 0.6).collect()}
    assert set(got) == {None, 92, *range(14)} and got[92].std == 0 and got[92].status == "warn" and got[None].scope == "pooled"
    for key, x in ((None, np.append(values.ravel(), -9.0)), *enumerate(values.reshape(14, -1))):
        r = got[key]
        inside = float(((x >= -9.5) & (x <= -9.1)).mean())
        assert (r.n, r.status) == (x.size, "pass" if inside >= 0.6 else "warn")
        want = [x.mean(), x.std(ddof=1), x.mean() + 9.3, x.std(ddof=1) - 0.2, (x < -9.5).mean(), inside, (x > -9.1).mean(), *np.quantile(x, list(K.LEVELS.values()))]
        assert [r.mean, r.std, r.mean_error, r.std_error, r.below, r.inside, r.above, *(r[n] for n in K.LEVELS)] == pytest.approx(want)
    assert K.marginal_report(fields.limit(0), 0.0, 1.0, -1.0, 1.0, 0.9).count() == 0


def test_ensemble_fidelity(fields, values):
    got = {(r.part, r.statistic): r.value for r in K.ensemble_fidelity(fields, F.col("sample_id") < 5, [1, 2, 3]).collect()}
    g, t = values[:5], values[5:]
    levels = list(K.LEVELS.values())
    assert [got["marginal", f"{n}_error"] for n in K.LEVELS] == pytest.approx(np.abs(np.quantile(g, levels) - np.quantile(t, levels)).tolist())
    assert got["marginal", "mean_error"] == pytest.approx(g.mean() - t.mean()) and got["marginal", "std_error"] == pytest.approx(g.std(ddof=1) - t.std(ddof=1))
    fine = np.linspace(0, 1, 200001)[:-1] + 2.5e-6
    plain = np.abs(np.sort(g.ravel())[(fine * g.size).astype(int)] - np.sort(t.ravel())[(fine * t.size).astype(int)]).mean()
    assert got["marginal", "w1"] == pytest.approx(plain, rel=1e-4)
    for part, (dr, dc) in K.DIRECTIONS.items():
        curve = lambda x: np.array([((x[:, k * dr :, k * dc :] - x[:, : 6 - k * dr, : 5 - k * dc]) ** 2).mean() / 2 for k in (1, 2, 3)])
        p, q = curve(g), curve(t)
        rmse = math.sqrt(((p - q) ** 2).mean())
        want = (rmse, rmse / math.sqrt((q * q).mean()), np.corrcoef(p, q)[0, 1])
        assert tuple(got[part, s] for s in ("rmse", "relative_rmse", "curve_correlation")) == pytest.approx(want)
    alone = {(r.part, r.statistic): r.value for r in K.ensemble_fidelity(fields, F.lit(True), [1]).collect()}
    assert set(alone) == set(got) and not any(v for v in alone.values())


def test_training_compatibility(spark):
    rows = [(k, k < 4, float(k), 1.0, None if k == 2 else float(k * k)) for k in range(10)]
    df = spark.createDataFrame(rows, "id long, generated boolean, a double, b double, c double")
    got = {r.metric: r for r in K.training_compatibility(df, F.col("generated"), ["a", "b", "c"]).collect()}
    a, t = np.arange(4.0), np.arange(4.0, 10)
    assert got["a"].z_score == pytest.approx((a.mean() - t.mean()) / t.std(ddof=1)) and got["a"].outside == 1 and (got["a"].training_min, got["a"].generated_max) == (4, 3)
    assert got["b"].z_score is None and got["b"].outside == 0 and got["c"].generated_n == 3 and got["c"].training_n == 6
    assert K.training_compatibility(df.limit(0), F.col("generated"), ["a"]).count() == 0


def test_raster_at_points(spark):
    rng = np.random.default_rng(2)
    image = rng.uniform(0.1, 2, (4, 5))
    image[1, 1], image[3, 0] = -1.0, float("nan")
    raster = spark.createDataFrame([(r, c, float(image[r, c])) for r in range(4) for c in range(5) if (r, c) != (0, 4)], "row int, col int, value double")
    a, e, left, top = 10.0, -20.0, 100.0, 500.0
    places = [(y, x) for y in np.arange(-0.5, 4, 0.25) for x in np.arange(-0.5, 5, 0.25)]
    rows = [(k, float(left + a * (x + 0.5)), float(top + e * (y + 0.5))) for k, (y, x) in enumerate(places)]
    rows += [rows[40], (900, None, 450.0), (901, float("nan"), 450.0)]
    points = spark.createDataFrame(rows, "id long, x_m double, y_m double").withColumn("row", F.lit(1)).repartition(3)
    out = raster_samples(points, raster, (a, 0.0, left, 0.0, e, top), 4, 5).collect()
    assert len(out) == len(rows) and sum(r.id == 40 for r in out) == 2
    got = {r.id: r for r in out}
    assert got[900].linear is None and not got[901].nearest_valid
    for k, (y, x) in enumerate(places):
        linear = nearest = math.nan
        if 0 <= y <= 3 and 0 <= x <= 4:
            r, c = min(int(y), 2), min(int(x), 3)
            u, w = y - r, x - c
            each = [((u if i else 1 - u) * (w if j else 1 - w), math.nan if (r + i, c + j) == (0, 4) else image[r + i, c + j]) for i in (0, 1) for j in (0, 1)]
            linear = sum(p * v for p, v in each if p)
            i, j = r + (u > 0.5), c + (w > 0.5)
            nearest = math.nan if (i, j) == (0, 4) else image[i, j]
        for name, want in (("linear", linear), ("nearest", nearest)):
            value = got[k][name]
            assert (value is None and math.isnan(want)) or value == pytest.approx(want)
            assert got[k][f"{name}_valid"] == (want > 0)
    with pytest.raises(ValueError):
        raster_samples(points, raster, (a, 1.0, left, 0.0, e, top), 4, 5)
