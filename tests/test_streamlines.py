"""Traced lines against closed forms, their stop, watchdog and rasters."""
import math

import numpy as np
import pytest
from gridweave.operators.streamlines import WatchdogError, lines, rasters, traced


def test_a_circle_is_closed():
    turn = lambda p: np.array([p[1] - 5, 5 - p[0]])
    path = traced(turn, (5.0, 8.0), (10.0, 10.0), 2 * math.pi, 101, tolerance=1e-8)
    assert len(path) == 101 and np.abs(path[:, 0] - np.linspace(0, 2 * math.pi, 101)).max() < 1e-12
    want = np.column_stack((5 + 3 * np.sin(path[:, 0]), 5 + 3 * np.cos(path[:, 0])))
    assert np.abs(path[:, 1:] - want).max() < 1e-4 and np.abs(path[-1, 1:] - (5, 8)).max() < 1e-6


def test_a_line_ends_at_the_border():
    path = traced(lambda p: np.array([0.0, 1.0]), (1.0, 1.0), (2.0, 2.0), 10.0, 101)
    assert path[-1].tolist() == pytest.approx([1.0, 1.0, 2.0]) and len(path) < 101 and (path[:, 1:] <= 2).all()
    grow = traced(lambda p: np.array([0.0, p[1]]), (0.0, 1.0), (1.0, 4.0), 10.0, 1001, tolerance=1e-8)
    assert grow[-1, 0] == pytest.approx(math.log(4), abs=1e-5)


def test_still_and_outside_starts():
    still = traced(lambda p: np.zeros(2), (1.0, 1.0), (2.0, 2.0), 3.0, 4)
    assert still[:, 0].tolist() == [0, 1, 2, 3] and (still[:, 1:] == 1).all()
    assert len(traced(lambda p: np.ones(2), (3.0, 1.0), (2.0, 2.0), 3.0, 4)) == 0


def test_the_watchdog_fails_loudly(spark):
    with pytest.raises(WatchdogError, match="more than 5"):
        traced(lambda p: np.array([0.0, 1.0]), (1.0, 1.0), (99.0, 99.0), 10.0, 11, most=5)
    fields = spark.createDataFrame([(4, [float(c) for _ in range(3) for c in range(3)])], "sample_id long, values array<double>")
    starts = spark.createDataFrame([(4, 7, 1.0, 1.0)], "sample_id long, line int, row double, col double")
    with pytest.raises(Exception, match="sample 4, line 7, pass 0"):
        lines(fields, starts, 3, 3, most=1).collect()


def test_lines_and_rasters_of_fields(spark):
    """Down an even slope lines are straight; each pass starts beside the last."""
    slope = [-float(c) for _ in range(6) for c in range(9)]
    fields = spark.createDataFrame([(0, slope), (1, [0.0] * 54)], "sample_id long, values array<double>")
    starts = spark.createDataFrame([(0, 0, 2.5, 1.0), (1, 0, 2.5, 1.0), (9, 0, 1.0, 1.0)], "sample_id long, line int, row double, col double")
    found = lines(fields, starts, 6, 9, (0.0, 3.0, -3.0), t_end=20.0, points=81)
    rows = found.orderBy("sample_id", "pass", "point").collect()
    own = [r for r in rows if r.sample_id == 0 and r["pass"] == 0]
    assert own[-1].col == pytest.approx(8.0) and own[-1].t == pytest.approx(7.0) and all(r.row == pytest.approx(2.5) for r in own)
    assert all(r.col == pytest.approx(1 + r.t) and r.fade == pytest.approx(1 - r.t / own[-1].t) for r in own)
    assert {(r.sample_id, r["pass"]) for r in rows} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    got = {(r.sample_id, r["pass"], r.row, r.col): r.value for r in rasters(found).collect()}
    want = {}
    for r in rows:
        key = (r.sample_id, r["pass"], math.floor(r.row), math.floor(r.col))
        want[key] = max(want.get(key, 0.0), r.fade)
    assert got == want and got[0, 0, 2, 1] == 1.0
