"""Closed forms, invariants and boundaries of what SQL doesn't check."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.functions import scalars as S, special as Z
from gridweave.operators import cells as C, fitting as X, guards as G, selection as L, summaries as M
from gridweave.randomfield import coordinates as K, fields as R
from gridweave.sources import files as IO
from gridweave.streaming import accumulators as A


def fields(spark, x):
    n, h, w = x.shape
    rows = [(i, r, c, float(x[i, r, c])) for i in range(n) for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, "sample_id long, row int, col int, value double")


def test_constant_fields_have_no_variance(spark):
    out = C.field_statistics(fields(spark, np.tile(np.arange(12.0).reshape(1, 3, 4), (6, 1, 1)))).collect()
    assert all(r.variance == 0 and r.std == 0 and r["count"] == 6 and r.min == r.max for r in out)


def test_one_sample_has_no_variance(spark):
    assert all(r.variance is None and r.std is None for r in C.field_statistics(fields(spark, np.ones((1, 2, 2)))).collect())


@pytest.mark.parametrize("comparison, want", [(">", 1 / 3), (">=", 2 / 3)])
def test_thresholds_compare_at_the_field_type(spark, comparison, want):
    x = fields(spark, np.array([0.0, 0.1, 0.2]).reshape(3, 1, 1))
    assert C.exceedance_probability(x, 0.0, [0.1], comparison).first().probability == pytest.approx(want)
    with pytest.raises(ValueError):
        C.exceedance_probability(x, 0.0, [0.1, 0.1])


def test_risk_without_an_event(spark):
    r = M.receptor_risk(fields(spark, np.zeros((4, 1, 1))), 0.0, 1.0).first()
    assert (r.exceed_count, r.probability, r.conditional_excess) == (0, 0.0, None)


def test_shortfall_shares_its_atom(spark):
    df = spark.createDataFrame([(float(v),) for v in [0] * 8 + [10] * 2], "value double")
    r = M.tail_risk(df, 0.9).first()
    assert (r.value_at_risk, r.expected_shortfall) == (10.0, 10.0)


def test_guard_raises_in_the_task(spark):
    df = spark.createDataFrame([(1.0,), (0.0,)], "value double")
    assert G.guarded(df).count() == 2
    with pytest.raises(Exception, match="not finite and positive"):
        G.guarded(df, positive=True).collect()


def test_scalars_round_trip(spark):
    x = F.col("x")
    df = spark.range(1, 50).select((F.col("id") / 10).alias("x"))
    mu, sigma = S.physical_to_lognormal(*S.lognormal_to_physical(F.log(x), x / 10))
    pairs = [
        (S.kh_to_k(S.k_to_kh(x)), x), (S.log_rescale_inverse(S.log_rescale(x, 0, 5), 0, 5), x), (S.rescale_inverse(S.rescale(x, 1, 3), 1, 3), x),
        (S.standardize_inverse(S.standardize(x, 1, 3), 1, 3), x), (mu, F.log(x)), (sigma, x / 10),
    ]
    worst = df.agg(*(F.max(F.abs(a - b)) for a, b in pairs)).first()
    assert max(worst) < 1e-9


def test_special_functions():
    p = np.array([1e-9, 0.025, 0.5, 0.9, 1 - 1e-9])
    assert Z.cdf(Z.ppf(p)) == pytest.approx(p, rel=1e-9)
    low, high = Z.clopper_pearson(0, 10)
    assert (low, high) == (0.0, pytest.approx(1 - 0.025 ** (1 / 10)))
    assert Z.clopper_pearson(3, 10)[0] < 0.3 < Z.clopper_pearson(3, 10)[1]


def test_draws_do_not_depend_on_partitions(spark):
    a = K.iid_gaussian(spark, 20, 3, 5).collect()
    b = K.drawn(spark, 20, 3, 5, lambda rng, m: rng.standard_normal(m)).repartition(7).orderBy("sample_id").collect()
    assert a == b


def test_hypercube_has_one_draw_a_stratum(spark):
    x = np.array([r.xi for r in K.latin_hypercube(spark, 32, 3, 1).collect()])
    assert (np.sort(np.floor((x + 1) / 2 * 32), axis=0) == np.arange(32)[:, None]).all()


def test_sobol_points_are_balanced(spark):
    x = np.array([r.xi for r in K.sobol(spark, 64, 5, 3, gaussian=False).collect()])
    assert (np.sort(np.floor(x * 64), axis=0) == np.arange(64)[:, None]).all()
    with pytest.raises(ValueError):
        K.sobol(spark, 60, 2, 1)


def test_expansion_meets_its_data(spark):
    kl = R.Expansion.fit(6, 6, -9.0, 0.5, 3.0, share=0.9999)
    assert (kl.variance() <= 0.25 + 1e-9).all()
    zero = spark.createDataFrame([(0, [0.0] * 40)], "sample_id long, xi array<double>")
    assert kl.map(zero).first()["values"] == pytest.approx([-9.0] * 36)
    out = kl.map_conditioned(K.iid_gaussian(spark, 5, 40, 2), [3, 20], [-9.4, -8.8]).collect()
    assert all(r["values"][3] == pytest.approx(-9.4, abs=1e-5) and r["values"][20] == pytest.approx(-8.8, abs=1e-5) for r in out)


def test_kriging_is_exact_at_its_data():
    at, values = [(0.0, 0.0), (3.0, 1.0), (5.0, 5.0)], [1.0, 2.0, -1.0]
    for mean in (0.5, None):
        m, v = R.Kriging.fit(at, values, 1.3, 2.0, mean).predict(np.array(at))
        assert m == pytest.approx(values, abs=1e-8) and v == pytest.approx([0, 0, 0], abs=1e-8)
    m, v = R.Kriging.fit(at, values, 1.3, 2.0, 0.5).predict(np.array([[1e6, 1e6]]))
    assert m[0] == pytest.approx(0.5) and v[0] == pytest.approx(1.69)


def test_conditional_draws_keep_the_data(spark):
    k = R.Kriging.fit([(1, 1), (6, 3)], [-0.2, 0.3], 0.3, 3.0, mean=0.0)
    for r in k.update(R.fft_fields(spark, 4, 8, 8, 0.3, 3.0, 1), 8).collect():
        assert r["values"][9] == pytest.approx(-0.2, abs=1e-8) and r["values"][30] == pytest.approx(0.3, abs=1e-8)


def test_fft_fields_have_their_variance(spark):
    x = np.array([r["values"] for r in R.fft_fields(spark, 400, 6, 6, 0.5, 2.0, 9).collect()])
    assert x.mean() == pytest.approx(0, abs=0.03) and x.var() == pytest.approx(0.25, rel=0.1)


def test_component_labels():
    mask = np.array([[1, 1, 0, 1], [0, 1, 0, 1], [1, 0, 0, 1]], bool)
    assert R.labels(mask).tolist() == [[1, 1, 0, 2], [0, 1, 0, 2], [3, 0, 0, 2]]



def test_variogram_fit_recovers_its_parameters():
    lag = np.linspace(1, 30, 20)
    got = X.fit_variogram(lag, 0.1 + 0.9 * (1 - np.exp(-lag / 6)), np.ones(20), "exponential")
    assert (got["nugget"], got["sill"], got["length"]) == pytest.approx((0.1, 0.9, 6.0), rel=1e-3)


def test_folds_keep_blocks_whole(spark):
    pts = spark.range(300).select("id", (F.col("id") * 37 % 1000).cast("double").alias("x_m"), (F.col("id") * 91 % 1000).cast("double").alias("y_m"))
    rows = L.balanced_folds(pts, 250.0, 4, 1).collect()
    assert len(rows) == 300 and len({(r.bx, r["by"], r.fold) for r in rows}) == len({(r.bx, r["by"]) for r in rows})
    parts = {r.id: r.part for r in L.spatial_partition(pts, 250.0, 0.2, 50.0, 1).collect()}
    assert len(parts) == 300 and set(parts.values()) <= {"train", "test", None} and "test" in parts.values()


def test_sequential_locations(spark):
    grid = [(6 * r + c, float(c), float(r)) for r in range(6) for c in range(6)]
    df = spark.createDataFrame([*grid, (None, 1.0, 1.0), (99, None, 1.0)], "id long, x_m double, y_m double")
    order = lambda t: [r.id for r in t.orderBy("place").collect()]
    at = {i: (x, y) for i, x, y in grid}
    chosen = order(L.boreholes(df, 4, 1.0, 2.0, 1))
    assert all(math.dist(at[a], at[b]) >= 2 for i, a in enumerate(chosen) for b in chosen[:i]) and all(1 <= x <= 4 and 1 <= y <= 4 for x, y in map(at.get, chosen))
    assert chosen == order(L.boreholes(df.repartition(5), 4, 1.0, 2.0, 1))
    far = [0]
    while len(far) < 5:
        far.append(max(at, key=lambda i: (min(math.dist(at[i], at[j]) for j in far), -i)))
    assert order(L.farthest_points(df, 5)) == far
    assert len(set(order(L.variance_locations(df, 6, 1.0, 2.0, 3)))) == 6
    assert order(L.weighted_locations(df, F.when(F.col("id") == 14, 1.0).otherwise(0.0), 1, 3.0, 0.0, 1)) == [14]
    with pytest.raises(ValueError):
        L.weighted_locations(df, F.lit(1.0), 30, 3.0, 0.1, 1)
    assert L.variance_locations(df.where("false"), 3, 1.0, 2.0, 3).count() == 0


def test_weighted_draws_follow_their_weights(spark):
    df = spark.createDataFrame([(k, float(k), 0.0) for k in range(4)], "id long, x_m double, y_m double")
    first = [L.weighted_locations(df, F.col("id") + 0.0, 1, 0.5, 0.0, seed).first().id for seed in range(40)]
    assert 0 not in first and first.count(3) > first.count(1)


def test_stream_equals_one_pass(spark, tmp_path):
    x = fields(spark, np.random.default_rng(1).normal(size=(9, 2, 3)))
    for k in range(3):
        x.where(f"sample_id % 3 = {k}").write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in/*")
    A.accumulate(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got, want = (sorted(d.select("row", "col", "count", "mean", "variance", "min", "max").collect()) for d in (A.state(spark, f"{tmp_path}/out"), C.field_statistics(x)))
    for a, b in zip(got, want, strict=True):
        assert tuple(a) == pytest.approx(tuple(b))


def test_files(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(3, 2, 4))
    np.savez(tmp_path / "a.npz", fields=x)
    got = IO.read_fields(spark, str(tmp_path / "a.npz")).orderBy("sample_id", "row", "col").collect()
    assert [r.value for r in got] == pytest.approx(x.ravel().tolist())
    IO.write_with_metadata(spark.range(5), str(tmp_path / "t"), {"name": "x"})
    df, meta = IO.read_with_metadata(spark, str(tmp_path / "t"))
    assert df.count() == meta["rows"] == 5
    (tmp_path / "grid.csv").write_text(" 1 2  3\n\n4 5 6\n")
    assert IO.read_table(spark, str(tmp_path / "grid.csv"), ["x", "y", "z"]).count() == 2


def test_ledger(spark, tmp_path):
    from gridweave.sources import ledger as J

    path = str(tmp_path / "x")
    assert J.written_once(spark.range(5), path).count() == 5
    assert J.written_once(spark.range(9), path).count() == 5  # complete: not written again
    spark.range(6).write.mode("overwrite").parquet(f"{path}/data")
    with pytest.raises(ValueError):
        J.written_once(spark.range(5), path)
    assert J.seed_for("a", 1) == J.seed_for("a", 1) != J.seed_for("a", 2) and 0 <= J.seed_for() < 1 << 64
