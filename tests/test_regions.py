"""Regions over tiles, and windows on other grids, against plain loops."""
import numpy as np
import pytest
from gridweave.operators.regions import centres, labelled
from gridweave.operators.spatial import resampled_window


def plain(mask):
    """The least cell of each marked cell's region, by flooding."""
    out = {}
    for start in zip(*np.nonzero(mask)):
        if start in out:
            continue
        ahead, seen = [start], {start}
        while ahead:
            r, c = ahead.pop()
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if 0 <= n[0] < mask.shape[0] and 0 <= n[1] < mask.shape[1] and mask[n] and n not in seen:
                    seen.add(n)
                    ahead.append(n)
        out.update(dict.fromkeys(seen, min(seen)))
    return {tuple(map(int, k)): tuple(map(int, v)) for k, v in out.items()}


def spiral(n):
    """One region that winds through all tiles."""
    mask, r, c, d = np.zeros((n, n), bool), 0, 0, (0, 1)
    mask[0, 0] = True
    for _ in range(n * n):
        a, b = r + d[0], c + d[1]
        e, f = r + 2 * d[0], c + 2 * d[1]
        if not (0 <= a < n and 0 <= b < n) or (0 <= e < n and 0 <= f < n and mask[e, f]):
            d = (d[1], -d[0])
            a, b = r + d[0], c + d[1]
            e, f = r + 2 * d[0], c + 2 * d[1]
            if not (0 <= a < n and 0 <= b < n) or (0 <= e < n and 0 <= f < n and mask[e, f]):
                break
        r, c = a, b
        mask[r, c] = True
    return mask


@pytest.mark.parametrize("tile", [1, 3, 64])
def test_regions_over_tiles(spark, tile):
    rng = np.random.default_rng(3)
    masks = [rng.random((11, 13)) < 0.55, spiral(12), np.zeros((3, 3), bool), np.ones((9, 4), bool)]
    rows = [(s, int(r), int(c)) for s, m in enumerate(masks) for r, c in zip(*np.nonzero(m))]
    df = spark.createDataFrame([*rows, rows[0], (None, 1, 1), (0, None, 1)], "sample_id long, row int, col int")
    got = {(r.sample_id, r.row, r.col): tuple(r.label) for r in labelled(df, tile).collect()}
    want = {(s, *k): v for s, m in enumerate(masks) for k, v in plain(m).items()}
    assert got == want
    found = sorted((r.sample_id, r.y, r.x, r.cells) for r in centres(df, tile).where("sample_id = 3").collect())
    assert found == [(3, 4.0, 1.5, 36)]


def test_no_cells(spark):
    assert centres(spark.createDataFrame([], "sample_id long, row int, col int")).collect() == []


def test_windows_on_another_grid(spark):
    x = np.random.default_rng(4).normal(size=(2, 5, 6))
    df = spark.createDataFrame([(s, r, c, float(x[s, r, c])) for s in range(2) for r in range(5) for c in range(6)], "sample_id long, row int, col int, value double")
    got = {(r.sample_id, r.row, r.col): r.value for r in resampled_window(df, (5, 6), 20.0, 5.0, (24, 20)).collect()}
    assert len(got) == 2 * 24 * 20
    for (s, row, col), value in got.items():
        a, b = (col + 0.5) * 0.25, (row + 0.5) * 0.25
        i, j = min(int(a), 3), min(int(b), 4)
        u, w = a - i, b - j
        f = x[s]
        want = f[i, j] * (1 - u) * (1 - w) + f[i + 1, j] * u * (1 - w) + f[i, j + 1] * (1 - u) * w + f[i + 1, j + 1] * u * w
        assert value == pytest.approx(want, abs=1e-12)
