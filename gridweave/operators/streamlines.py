"""Streamlines with error control, a stop at the border, a watchdog, and faded rasters.

Steps are those of Dormand and Prince: a fifth-order step whose fourth-order
companion tells its error, so steps shrink where the flow turns and grow where
it is even. A step that leaves the grid is ended at the border. A line that
needs more evaluations than allowed fails its task with its sample and start:
a line that is cut silently would look like one that has ended.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: The tableau of the method: nodes' weights, the fifth-order weights, and their difference from the fourth-order ones.
STAGES = (
    (1 / 5,), (3 / 40, 9 / 40), (44 / 45, -56 / 15, 32 / 9), (19372 / 6561, -25360 / 2187, 64448 / 6561, -212 / 729),
    (9017 / 3168, -355 / 33, 46732 / 5247, 49 / 176, -5103 / 18656), (35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84),
)
ERROR = (71 / 57600, 0, -71 / 16695, 71 / 1920, -17253 / 339200, 22 / 525, -1 / 40)


class WatchdogError(RuntimeError):
    """A line took more evaluations than allowed."""


def between(t: float, h: float, a: np.ndarray, b: np.ndarray, fa: np.ndarray, fb: np.ndarray) -> np.ndarray:
    """The cubic with the places and slopes of a step's ends, at a share t of it."""
    return (1 - t) ** 2 * ((1 + 2 * t) * a + t * h * fa) + t * t * ((3 - 2 * t) * b - (1 - t) * h * fb)


def traced(flow: Callable[[np.ndarray], np.ndarray], start, upper, t_end: float, points: int, tolerance: float = 1e-6, most: int = 100_000) -> np.ndarray:
    """t and place at equal times of a line from a start, up to t_end or the border of 0 to upper; the last row is where it ends."""
    place, upper = np.asarray(start, float), np.asarray(upper, float)
    inside = lambda p: bool(((p >= 0) & (p <= upper)).all())
    if not inside(place):
        return np.empty((0, 1 + len(place)))
    used, t, now = 1, 0.0, flow(place)
    speed = float(np.abs(now).max())
    h, times = min(t_end, 0.1 / speed if speed > 0 else t_end), np.linspace(0, t_end, points)
    out, k = [(0.0, *place)], 1
    while t < t_end:
        h, slopes = min(h, t_end - t), [now]
        for weights in STAGES:
            target = place + h * sum(w * s for w, s in zip(weights, slopes))
            slopes.append(flow(target))
        used += len(STAGES)
        if used > most:
            raise WatchdogError(f"more than {most} evaluations, at t = {t:.6g} and {place.tolist()}")
        size = float(np.abs(h * sum(w * s for w, s in zip(ERROR, slopes))).max()) / tolerance
        if size > 1:
            h *= max(0.2, 0.9 * size**-0.2)
            continue
        after, last = target, slopes[-1]
        at = lambda s, h=h, a=place, b=after, fa=now, fb=last: between(s, h, a, b, fa, fb)
        share = 1.0
        if not inside(after):
            low = 0.0
            for _ in range(60):
                middle = (low + share) / 2
                low, share = (middle, share) if inside(at(middle)) else (low, middle)
            share = low
        while k < points and times[k] <= t + share * h:
            out.append((times[k], *at((times[k] - t) / h)))
            k += 1
        if share < 1:
            if t + share * h > out[-1][0]:
                out.append((t + share * h, *at(share)))
            break
        t, place, now = t + h, after, last
        h *= min(5.0, 0.9 * max(size, 1e-10) ** -0.2)
    return np.array(out)


def bilinear_flow(u: np.ndarray, v: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The velocity (row, col) at a place of a grid's nodes; places outside take the border's cell on."""
    h, w = u.shape

    def at(p: np.ndarray) -> np.ndarray:
        i, j = min(max(int(p[0]), 0), h - 2), min(max(int(p[1]), 0), w - 2)
        a, b = min(max(p[0] - i, 0.0), 1.0), min(max(p[1] - j, 0.0), 1.0)
        mix = lambda f: (1 - a) * ((1 - b) * f[i, j] + b * f[i, j + 1]) + a * ((1 - b) * f[i + 1, j] + b * f[i + 1, j + 1])
        return np.array([mix(v), mix(u)])

    return at


#: Points of lines that leave a task together, about.
POINTS = 20_000


def line_frames(frames: Iterable[pd.DataFrame], height: int, width: int, offsets: tuple[float, ...], speed: float, t_end: float, points: int, most: int) -> Iterator[pd.DataFrame]:
    """The points of all lines (sample_id, values, line, row, col), some lines at a time, so a task holds few of them."""
    names = ["sample_id", "line", "pass", "point", "t", "fade", "row", "col"]
    for x in frames:
        rows = []
        for i, values, line, row, col in x[["sample_id", "values", "line", "row", "col"]].itertuples(index=False):
            field = np.reshape(np.asarray(values, float), (height, width))
            if not np.isfinite(field).all():
                raise ValueError(f"the field of sample {i} is not finite")
            v, u = np.gradient(-speed * field)
            for k, offset in enumerate(offsets):
                try:
                    path = traced(bilinear_flow(u, v), (row, col + offset), (height - 1, width - 1), t_end, points, most=most)
                except WatchdogError as why:
                    raise WatchdogError(f"sample {i}, line {line}, pass {k}: {why}") from None
                end = path[-1, 0] if len(path) else 0.0
                rows += [(i, line, k, n, t, 1 - t / end if end > 0 else 1.0, r, c) for n, (t, r, c) in enumerate(path.tolist())]
                if len(rows) >= POINTS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        yield pd.DataFrame(rows, columns=names)


def lines(fields: DataFrame, starts: DataFrame, height: int, width: int, offsets: tuple[float, ...] = (0.0,), speed: float = 1.0, t_end: float = 27.5, points: int = 200, most: int = 100_000) -> DataFrame:
    """sample_id, line, pass, point, t, fade, row, col: lines down the gradient of each sample's field (values, row by row) from its starts.

    starts: sample_id, line, row, col. Each is traced once for each offset of
    its column; a start outside the grid has no points. fade falls from 1 at
    the start to 0 at the end of the line. Fields have to be finite.
    """
    schema = "sample_id long, line int, pass int, point int, t double, fade double, row double, col double"
    each = starts.select("sample_id", F.col("line").cast("int").alias("line"), F.col("row").cast("double").alias("row"), F.col("col").cast("double").alias("col"))
    asked = fields.select("sample_id", "values").join(each, "sample_id")

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return line_frames(frames, height, width, offsets, speed, t_end, points, most)

    return asked.mapInPandas(run, schema)


def rasters(found: DataFrame) -> DataFrame:
    """sample_id, pass, row, col, value: the strongest fade of any line in each cell that one crosses."""
    return found.groupBy("sample_id", "pass", F.floor("row").cast("int").alias("row"), F.floor("col").cast("int").alias("col")).agg(F.max("fade").alias("value"))
