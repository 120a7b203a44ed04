"""Every query with SQL against another engine, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from gridweave import plans

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = plans.queries(), plans.oracles()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        made.execute(f"create view {os.path.basename(f).removesuffix('.parquet')} as select * from '{f}'")
    return made


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-5, abs_tol=2e-6) or math.isnan(a) and math.isnan(b)
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    rows = [r.asDict() for r in QUERIES[name](spark, FOLDER).collect()]
    made = con.execute(ORACLES[name])
    names = [c[0] for c in made.description]
    want = [dict(zip(names, r, strict=True)) for r in made.fetchall()]
    assert len(rows) == len(want)
    if not rows:
        return
    assert sorted(rows[0]) == sorted(names)
    exact = [n for n in sorted(names) if not any(isinstance(r[n], float) for r in want)]
    loose = [n for n in sorted(names) if n not in exact]
    key = lambda r: (*(str(r[n]) for n in exact), *(str(round(r[n], 3) + 0.0) if r[n] is not None else "" for n in loose))
    for a, b in zip(sorted(rows, key=key), sorted(want, key=key), strict=True):
        assert all(close(a[n], b[n]) for n in names), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_partitions_do_not_matter(spark):
    from gridweave.operators.cells import field_statistics
    from gridweave.sources.views import Views

    fields = Views(spark, FOLDER).fields_long
    got = [sorted(field_statistics(fields.repartition(n)).collect()) for n in (1, 3, 8)]
    for a in got[1:]:
        for x, y in zip(a, got[0], strict=True):
            assert all(close(p, q) for p, q in zip(x, y, strict=True))
