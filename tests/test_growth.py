"""What larger tables meet: no table that grows is sent to every task, and repeated places are worked on once."""

import contextlib
import io

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from gridweave.operators import distributions as D, likelihood as L, spatial as P, streamlines as T
from gridweave.randomfield.continuous import SHARING, ContinuousExpansion


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def fields(spark, values: np.ndarray):
    rows = [(i, r, c, float(values[i, r, c])) for i in range(len(values)) for r in range(values.shape[1]) for c in range(values.shape[2])]
    return spark.createDataFrame(rows, "sample_id long, row int, col int, value double")


def test_variograms_send_no_side_to_every_task(spark):
    x = np.random.default_rng(1).normal(size=(3, 5, 4))
    found = P.directional_variograms(fields(spark, x), {"y": (1, 0), "other": (1, -1)}, [1, 2])
    assert "Broadcast" not in plan(found)
    assert "Broadcast" not in plan(P.lag_pairs(fields(spark, x), 1, 2))
    got = {(r.direction, r.lag): r for r in found.collect()}
    a, b = x[:, :-2, 2:].ravel(), x[:, 2:, :-2].ravel()
    one = got["other", 2]
    assert one.pairs == len(a) and np.isclose(one.distance, 2 * 2**0.5)
    assert np.isclose(one.gamma, ((a - b) ** 2).mean() / 2) and np.isclose(one.correlation, np.corrcoef(a, b)[0, 1])


def readings(spark, n: int, places: int, seed: int = 2):
    """id, x_m, y_m, value, many at one place; the values of some are null."""
    rng = np.random.default_rng(seed)
    at, of = rng.integers(0, 40, (places, 2)) * 50.0, rng.integers(0, places, n)
    values = [None if k % 17 == 0 else float(x) for k, x in enumerate(rng.normal(5, 1, n))]
    rows = [(k, float(at[p, 0]), float(at[p, 1]), v) for k, (p, v) in enumerate(zip(of, values))]
    return rows, spark.createDataFrame([*rows, (n, None, 0.0, 1.0)], "id long, x_m double, y_m double, value double")


def plain_pairs(rows, most):
    return [(a, b, float(np.hypot(b[1] - a[1], b[2] - a[2]))) for k, a in enumerate(rows) for b in rows[k + 1 :] if np.hypot(b[1] - a[1], b[2] - a[2]) <= most]


def test_point_pairs_at_repeated_places(spark):
    rows, df = readings(spark, 120, 30)
    found = P.point_pairs(df, 400.0)
    assert "Broadcast" not in plan(found)
    got = sorted((r.id, r.id2, r.value, r.value2, r.dx, r.dy, r.distance) for r in found.collect())
    assert got == sorted((a[0], b[0], a[3], b[3], b[1] - a[1], b[2] - a[2], d) for a, b, d in plain_pairs(rows, 400.0))


def test_point_variogram_pairs_places_not_points(spark):
    """3,600 points at 12 places are 6 million pairs of points, which a join of points would make."""
    rows, df = readings(spark, 150, 40)
    want = {}
    for a, b, d in plain_pairs(rows, 400.0):
        angle = np.degrees(np.arctan2(abs(b[2] - a[2]), abs(b[1] - a[1])))
        names = ["x"] * int(angle <= 22.5) + ["y"] * int(angle >= 67.5) + ["diagonal"] * int(abs(angle - 45) < 22.5 and (b[1] - a[1]) * (b[2] - a[2]) > 0)
        for n in names if d > 0 else ():
            want.setdefault((n, int(d // 100)), []).append((d, None if a[3] is None or b[3] is None else (a[3] - b[3]) ** 2))
    got = {(r.direction, r.bin): r for r in P.point_variogram(df, 400.0, 100.0).collect()}
    assert set(got) == set(want)
    for k, pairs in want.items():
        known = [s for _, s in pairs if s is not None]
        assert got[k].pairs == len(pairs) and np.isclose(got[k].mean_lag, np.mean([d for d, _ in pairs])) and np.isclose(got[k].gamma, np.mean(known) / 2)
    many = df.where("x_m is not null").limit(12).join(spark.range(300).withColumnRenamed("id", "copy")).selectExpr("id * 300 + copy as id", "x_m", "y_m", "value")
    assert "id2" not in plan(P.point_variogram(many, 400.0, 100.0))


def test_likelihood_of_repeated_places_is_that_of_all_readings(spark):
    rng = np.random.default_rng(3)
    places, of = rng.uniform(0, 3000, (14, 2)), rng.integers(0, 14, 60)
    at, y, held = places[of], rng.normal(-2, 0.5, 60), [[int(k)] for k in of % 3]
    df = spark.createDataFrame([(0, 0, *map(float, p), float(v), h) for p, v, h in zip(at, y, held)], "block_x int, block_y int, x_m double, y_m double, value double, held array<int>")
    assert L.gathered(df).count() == len(np.unique(of))
    logs = np.log([900.0, 0.6, 0.3])
    asked = [(0, None, "exponential", "constant", logs), (1, None, "matern32", "linear", logs + 0.1), (2, 1, "gaussian", "linear", logs), (3, None, "exponential", "constant", logs - 0.2)]
    got = L.objectives(df, asked)
    for number, fold, family, trend, p in asked:
        own = at[[fold not in h for h in held]]
        values = y[[fold not in h for h in held]]
        value, gradient = L.restricted(np.hypot(own[:, :1] - own[:, 0], own[:, 1:] - own[:, 1]), values, L.trend_basis(own, trend), p, family)
        assert np.isclose(got[number][0], value) and np.allclose(got[number][1], gradient) and got[number][2] == len(own)


def test_weights_of_any_number_are_summed_by_place(spark):
    rng = np.random.default_rng(4)
    at, alpha = rng.integers(0, 60, (5000, 2)) * 20.0, rng.normal(0, 0.1, 5000)
    weights = spark.createDataFrame([(*map(float, p), float(a)) for p, a in zip(at, alpha)], "ox double, oy double, alpha double")
    asked = spark.createDataFrame([(1, 30.0, 40.0), (2, 30.0, 40.0), (3, 500.0, 7.0), (4, None, 7.0)], "id long, x_m double, y_m double")
    many = weights.selectExpr("*", "explode(sequence(1, 25)) as copy").drop("copy")
    found = D.simple_kriging_mean(asked, many, -0.4, 300.0)
    got = {r.id: r.mean for r in found.collect()}
    for i, x, y in ((1, 30, 40), (2, 30, 40), (3, 500, 7)):
        assert np.isclose(got[i], -0.4 + 25 * (alpha * np.exp(-np.hypot(at[:, 0] - x, at[:, 1] - y) / 300)).sum())
    assert got[4] is None and "Broadcast" not in plan(found)


def test_cross_covariances_send_no_side_to_every_task(spark):
    rows, df = readings(spark, 80, 25)
    found = P.kriging_cross(df, df.where("id % 3 = 0"), 300.0, 0.16, 500.0)
    assert "Broadcast" not in plan(found)
    got = {(r.id, r.other): r.covariance for r in found.collect()}
    want = {(a[0], b[0]): 0.16 * np.exp(-d / 500) for a in rows for b in rows if b[0] % 3 == 0 and (d := np.hypot(a[1] - b[1], a[2] - b[2])) <= 300}
    assert set(got) == set(want) and all(np.isclose(got[k], want[k]) for k in want)


def test_median_of_all_pairs_by_counting_passes(spark):
    x = np.random.default_rng(5).normal(size=(41, 3, 3))
    x[7], x[9] = x[3], x[3]
    flat = x.reshape(41, -1)
    want = np.array([np.sqrt(((flat[i] - flat[j]) ** 2).mean()) for i in range(41) for j in range(i + 1, 41)])
    for most in (10_000, 1):
        got = D.pair_rms_summary(fields(spark, x), block=16, most=most).first()
        assert np.isclose(got.median_rms, np.median(want)) and np.isclose(got.max_rms, want.max())
    assert np.allclose(sorted(r.rms for r in D.pairwise_rms(fields(spark, x), block=16).collect()), sorted(want), atol=1e-7)
    assert D._dealt_pairs(fields(spark, x), None).groupBy("sample_id").count().agg({"count": "max"}).first()[0] == 1


def test_lines_leave_a_task_some_at_a_time(monkeypatch):
    x = np.random.default_rng(6).normal(size=(30, 64))
    frame = pd.DataFrame({"sample_id": range(30), "values": list(x), "line": 0, "row": 3.0, "col": 3.0})
    ask = lambda: list(T.line_frames([frame], 8, 8, (0.0, 1.0), 4.0, 27.5, 200, 100_000))
    (whole,) = ask()
    monkeypatch.setattr(T, "POINTS", 500)
    parts = ask()
    assert len(parts) > 3 and max(map(len, parts)) < 700
    pd.testing.assert_frame_equal(pd.concat([p for p in parts if len(p)], ignore_index=True), whole)


def test_draws_of_any_number_at_all_points(spark):
    """More draws than one block or 4,096, most points at one place; nothing is sent to every task, a row of values is shared by a bounded number of points."""
    found = ContinuousExpansion.fit(4, 5, 5.0, -9.3, 0.4, 15.0)
    many = SHARING + 9
    rows = [*((k, 3.0, 4.0) for k in range(many)), (many, 11.0, 2.5), (many, 11.0, 2.5), (many + 1, 99.0, 1.0), (many + 2, None, 1.0), (None, 3.0, 4.0)]
    points = spark.createDataFrame(rows, "id long, x_m double, y_m double").repartition(3)
    draws = spark.range(4200).selectExpr("id as sample_id", f"transform(sequence(1, {found.size + 1}), k -> double(sin(id * k))) as xi")
    draws = draws.unionByName(draws.where("sample_id = 7"))
    asked = found.draws_at(points, draws, digits=6)
    assert "Broadcast" not in plan(asked)
    got = asked.toPandas().sort_values(["id", "sample_id"], na_position="last")
    assert len(got) == len(rows) * 4201
    xi = np.sin(np.outer(np.sort([*range(4200), 7]), np.arange(1, found.size + 1)))
    inside = [r for r in rows if r[1] is not None and r[1] < 99]
    want = -9.3 + found.basis(*np.array([r[1:] for r in inside]).T) @ xi.T
    known = got[got["value"].notna()]
    assert np.abs(known["value"].to_numpy() - _by_id(inside, want)).max() < 6e-7
    assert sorted(got[got["value"].isna()]["id"].unique()) == [many + 1, many + 2] and got["value"].isna().sum() == 2 * 4201
    plain = found.draws_at(points, draws).withColumn("value", F.round("value", 6) + F.lit(0.0))
    assert plain.exceptAll(asked).isEmpty() and asked.exceptAll(plain).isEmpty()
    assert found.draws_at(points, draws.where("false")).isEmpty() and found.draws_at(points.where("false"), draws).isEmpty()


def _by_id(rows, values):
    """Values of (row, draw) as they are sorted by id, null last, and draw; rows of one id have the same values."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    out, k = [], 0
    while k < len(order):
        same = [j for j in order[k:] if rows[j][0] == rows[order[k]][0]]
        out.append(np.repeat(values[same[0]], len(same)))
        k += len(same)
    return np.concatenate(out)
