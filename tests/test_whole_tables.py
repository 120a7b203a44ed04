"""Point queries use every row, and kriging in blocks agrees with the whole system."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave import plans
from gridweave.operators import fitting as X
from gridweave.randomfield import fields as R
from gridweave.sources.views import Views

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def observations(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    at = rng.uniform(0, 5000, (n, 2))
    value = np.sin(at[:, 0] / 900) + np.cos(at[:, 1] / 700) + 0.1 * rng.normal(size=n)
    rows = [(i, float(x), float(y), float(z)) for i, ((x, y), z) in enumerate(zip(at, value, strict=True))]
    return at, value, spark.createDataFrame(rows, "id long, x_m double, y_m double, value double")


@pytest.mark.parametrize("mean", [None, 0.1])
@pytest.mark.parametrize("n, tolerance", [(200, 1e-8), (1200, 0.05)])
def test_kriging_in_blocks(spark, mean, n, tolerance):
    at, value, table = observations(spark, n)
    doubled = table.unionByName(table.where("id < 20").withColumn("value", F.col("value") + 1))
    want = R.Kriging.fit(np.vstack((at, at[:20])), np.append(value, value[:20] + 1), 0.8, 800.0, mean, 0.05).predict(at)
    got = {r.id: r for r in X.local_kriging(table, doubled, 0.8, 800.0, mean, 0.05).collect()}
    assert len(got) == n
    assert max(abs(got[i].mean - want[0][i]) for i in got) < tolerance and max(abs(got[i].variance - want[1][i]) for i in got) < tolerance


def test_kriging_far_from_observations(spark):
    _, _, table = observations(spark, 600)
    far = spark.createDataFrame([(1, 90000.0, -70000.0)], "id long, x_m double, y_m double")
    r = X.local_kriging(far, table, 0.8, 800.0, None, 0.05).first()
    assert r.id == 1 and r.mean is not None and r.variance > 0


def test_blocks_of_a_small_table_are_the_whole(spark):
    _, _, table = observations(spark, 120)
    candidates = [(0.5, 500.0, 0.05), (0.8, 900.0, 0.05)]
    key = lambda r: (r.sigma, r.length)
    for a, b in zip(sorted(X.block_covariance_scores(table, candidates).collect(), key=key), sorted(X.covariance_scores(table, candidates).collect(), key=key), strict=True):
        assert a.likelihood == pytest.approx(b.likelihood)
    folded = table.withColumn("fold", (F.col("id") % 5).cast("int"))
    want = {r.id: r for r in X.block_cross_validation(folded, 0.8, 800.0, 0.05).collect()}
    got = {r.id: r for r in X.local_cross_validation(folded, 5, 0.8, 800.0, 0.05).collect()}
    assert got.keys() == want.keys() and all(got[i].mean == pytest.approx(want[i].mean) and got[i].std == pytest.approx(want[i].std) for i in got)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")
def test_queries_use_every_row(spark):
    v, queries = Views(spark, FOLDER), plans.queries()
    good, every = v.good_points.count(), v.points.count()
    assert queries["spatial_block_cv"](spark, FOLDER).select("id").distinct().count() == good
    places = v.good_points.select("x_m", "y_m").distinct().count()
    assert queries["condition_number"](spark, FOLDER).agg(F.sum("n")).first()[0] == places
    stated = v.table("embeddings").where("vec_id % 100 = 0").count()
    assert queries["kl_at_points"](spark, FOLDER).count() == every * stated
    assert queries["streamlines"](spark, FOLDER).select("sample_id").distinct().count() == v.table("embeddings").count()
    rows = v.good_points.orderBy("id").collect()
    want = R.Kriging.fit([(r.x_m, r.y_m) for r in rows], [r.log10_k for r in rows], 0.4, 2000.0, nugget=0.05).predict(np.array([(r.x_m, r.y_m) for r in rows]))[0]
    got = {r.id: r.mean for r in queries["ordinary_kriging"](spark, FOLDER).collect()}
    assert len(got) == every and all(abs(got[r.id] - m) < 1e-5 for r, m in zip(rows, want, strict=True))
