"""What larger tables must not change or cost more: blocks of places, folds kriged together, pairs by arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.operators import distributions as D, likelihood as L, spatial as P
from gridweave.operators.fitting import local_kriging


def plan(df):
    return df._jdf.queryExecution().toString()


def readings(spark, n=90, seed=3):
    rng = np.random.default_rng(seed)
    at, value = rng.uniform(0, 3000, (n, 2)), rng.normal(-2, 0.5, n)
    return spark.createDataFrame([(k, *map(float, p), float(v)) for k, (p, v) in enumerate(zip(at, value))], "id long, x_m double, y_m double, value double")


def test_blocks_hold_places_and_not_readings(spark):
    df = readings(spark)
    many = df.selectExpr("*", "explode(sequence(1, 50)) as copy")
    blocks = lambda x: {(r.x_m, r.y_m): (r.block_x, r.block_y) for r in L.keyed_blocks(x, 30).collect()}
    assert blocks(many) == blocks(df) and len(set(blocks(df).values())) > 1


def test_folds_are_kriged_together_as_one_by_one(spark):
    df = readings(spark, 900).withColumn("fold", (F.col("id") % 3).cast("int"))
    model = lambda k: [{"model": t, "sigma": 0.4 + 0.1 * k, "length": 500.0, "nugget": 0.05, "family": "matern32", "trend": t} for t in ("constant", "linear")]
    train = df.select("x_m", "y_m", "value", F.explode(F.array_except(F.array(*map(F.lit, range(3))), F.array("fold"))).alias("fold"))
    # The second fold has few observations, which are looked for in larger blocks.
    train = train.where("fold <> 1 or x_m < 700")
    asked = df.unionByName(df.where("fold = 1").withColumns({"id": F.col("id") + 5000, "x_m": F.col("x_m") + 9000}))
    got = {(r.fold, r.model, r.id): r for r in local_kriging(asked, train, models={k: model(k) for k in range(3)}, by="fold").collect()}
    for k in range(3):
        for r in local_kriging(asked.where(F.col("fold") == k), train.where(F.col("fold") == k), models=model(k)).collect():
            one = got.pop((k, r.model, r.id))
            assert (one.mean, one.variance) == (pytest.approx(r.mean, abs=1e-12), pytest.approx(r.variance, abs=1e-12))
    assert not got


def test_scores_of_folds_and_their_choice(spark):
    rng = np.random.default_rng(5)
    rows = [(m, k, f"{k}/{b}", float(rng.normal()), float(c + rng.random())) for m, c in (("a", 0.3), ("b", 0.0), ("c", 0.1)) for k in range(2) for b in range(3) for _ in range(1 + 4 * b)]
    scored = spark.createDataFrame(rows, "model string, fold int, block string, e double, crps double")
    fits = spark.createDataFrame([(m, k, "failed" if (m, k) == ("b", 1) else "converged") for m in "abcd" for k in range(2)], "model string, fold int, status string")
    for r in L.scored_folds(fits, scored).collect():
        own = [x for x in rows if x[:2] == (r.model, r.fold)]
        assert r.chosen == (r.model == L.chosen(scored.select("model", "block", "crps"), fits)) == (r.model == "c")
        assert r.n == (len(own) or None)
        if own:
            assert (r.rmse, r.crps) == (pytest.approx(np.sqrt(np.mean([x[3] ** 2 for x in own]))), pytest.approx(np.mean([x[4] for x in own])))


def drawn_fields(spark, x):
    rows = [(k, r, c, float(x[k, r, c])) for k in range(len(x)) for r in range(x.shape[1]) for c in range(x.shape[2])]
    return spark.createDataFrame(rows, "sample_id long, row int, col int, value double")


def test_a_draw_is_written_once_for_pairs_of_many_blocks(spark):
    x = np.random.default_rng(6).normal(size=(60, 2, 3))
    df = drawn_fields(spark, x)
    assert D._dealt_pairs(df, 5).count() == 60
    found = D.pairwise_rms(df, block=5, digits=6)
    assert "CartesianProduct" in plan(found) and "Broadcast" not in plan(found)
    got = {(r.a, r.b): r.rms for r in found.collect()}
    flat = x.reshape(60, -1)
    assert len(got) == 60 * 59 // 2
    assert all(got[a, b] == pytest.approx(np.sqrt(((flat[a] - flat[b]) ** 2).mean()), abs=5.1e-7) and got[a, b] == round(got[a, b], 6) for a, b in got)


def test_values_are_rounded_as_spark_rounds_them(spark):
    x = np.concatenate((np.random.default_rng(7).uniform(0, 3, 3000), np.arange(1, 400, 2) * 5e-7, np.arange(1, 400, 2) / 2**7, [0.0, 1e-9, 4.5e15, 1e300, np.inf]))
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "v double").select(F.round("v", 6)).collect()]
    assert D.half_up(x, 6).tolist() == want and np.isnan(D.half_up(np.array([np.nan]), 6)[0])


@pytest.mark.parametrize("about, scale", [((0.0, 1e-3), 0.01), ((0.9, 1.9), 1.0), ((50.0, 60.0), 1.0), (None, 0.02)])
def test_the_median_is_found_wherever_some_draws_say(spark, monkeypatch, about, scale):
    x = np.random.default_rng(8).normal(size=(33, 3, 3)) * scale + 40.0
    monkeypatch.setattr(D, "_about_middle", lambda own, draws, *whole: about or whole)
    flat = x.reshape(33, -1)
    want = [np.sqrt(((flat[i] - flat[j]) ** 2).mean()) for i in range(33) for j in range(i + 1, 33)]
    got = D.pair_rms_summary(drawn_fields(spark, x), block=16, most=40).first()
    assert (got.median_rms, got.max_rms) == (pytest.approx(np.median(want)), pytest.approx(max(want)))


def test_points_of_a_place_are_paired_by_arrays(spark, monkeypatch):
    monkeypatch.setattr(P, "IDS", 7)
    rng = np.random.default_rng(9)
    rows = [(k, *(100.0 * rng.integers(0, 6, 2)).tolist()) for k in range(120)] + [(200 + k, 250.0, 250.0) for k in range(30)] + [(300, None, 1.0), (0, 100.0, 300.0)]
    df = spark.createDataFrame(rows, "id long, x_m double, y_m double")
    near = [(a[0], b[0], np.hypot(a[1] - b[1], a[2] - b[2])) for a in rows for b in rows if a[1] is not None and b[1] is not None]
    near = [x for x in near if x[2] <= 230]
    found = P.pair_distances(df, 230.0, digits=6)
    # A pair of places is a row up to the last two steps.
    assert plan(found).count("Generate explode") >= 2 and "Broadcast" not in plan(found)
    assert sorted((r.id, r.id2, r.distance) for r in found.collect()) == sorted((a, b, round(d, 6)) for a, b, d in near if a < b)
    other = df.where("id % 3 = 0")
    got = sorted((r.id, r.other, round(r.covariance, 5)) for r in P.kriging_cross(df, other, 230.0, 0.16, 500.0, digits=6).collect())
    assert got == sorted((a, b, round(round(0.16 * np.exp(-d / 500), 6), 5)) for a, b, d in near if b % 3 == 0)


def test_deviations_take_pairs_from_blocks_written_once(spark):
    from types import SimpleNamespace

    from gridweave.plans.studies import conditioning_deviation

    df = drawn_fields(spark, 0.1 * np.random.default_rng(10).normal(size=(12, 2, 2)))
    found = conditioning_deviation(SimpleNamespace(fields_long=df, reference_field=df.where("sample_id = 0").drop("sample_id")))
    assert "CartesianProduct" in plan(found)
    got = {(r.part, r.key): r.value for r in found.collect()}
    assert all(v is None or v == round(v, 6) for v in got.values()) and {p for p, _ in got} == {"draws", "cells", "designs", "pairs"}
    want = {("pairs", f"{r.a}/{r.b}/rms"): r.rms for r in D.pairwise_rms(df, digits=6).collect()}
    assert len(want) == 66 and {k: v for k, v in got.items() if k[0] == "pairs"} == want
