"""Sequential selections of locations, and partitions of points into blocks.

Choosing one location after another depends on all chosen before: each choice
is one aggregate over the candidates, which may be many, and a few choices are
made. Folds are balanced on the driver over a checked number of blocks; points
meet their result by a join.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, functions as F

from gridweave.operators.spatial import block_key, buffered_training, dilated
from gridweave.randomfield.fields import Kriging

#: Blocks that folds are balanced over.
MOST_BLOCKS = 1_000_000


def balanced_folds(points: DataFrame, size: float, folds: int, seed: int, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Points with a fold: blocks in seeded order, larger first, each into the smallest fold so far; blocks stay whole."""
    keyed = block_key(points, size, x0, y0)
    counts = keyed.groupBy("bx", "by").agg(F.count("*").alias("n"))
    if counts.limit(MOST_BLOCKS + 1).count() > MOST_BLOCKS:
        raise ValueError(f"blocks of this size are more than {MOST_BLOCKS}")
    blocks = counts.orderBy(F.desc("n"), F.xxhash64("bx", "by", F.lit(seed))).collect()
    load, out = [0] * folds, []
    for b in blocks:
        fold = load.index(min(load))
        load[fold] += b["n"]
        out.append((b["bx"], b["by"], fold))
    table = points.sparkSession.createDataFrame(out, "bx int, `by` int, fold int")
    return keyed.join(F.broadcast(table), ["bx", "by"])


def spatial_partition(points: DataFrame, size: float, share: float, buffer_m: float, seed: int) -> DataFrame:
    """Points with part: a seeded share of blocks tests, points outside their buffer train, those between are null."""
    keyed = block_key(points, size)
    blocks = keyed.select("bx", "by").distinct()
    count = math.ceil(share * blocks.count())
    test = blocks.orderBy(F.xxhash64("bx", "by", F.lit(seed)), "bx", "by").limit(count)
    train = buffered_training(points, test, size, buffer_m).select("id", F.lit("train").alias("part"))
    held = keyed.join(test, ["bx", "by"]).select("id", F.lit("test").alias("part"))
    return points.join(train.unionByName(held), "id", "left")


def grid_partition(cells: DataFrame, size: int, share: float, buffer: int, height: int, width: int, seed: int) -> DataFrame:
    """Cells with part: seeded test blocks, a dilated buffer around them (null), the rest trains."""
    keyed = cells.withColumns({"br": F.floor(F.col("row") / size), "bc": F.floor(F.col("col") / size)})
    blocks = keyed.select("br", "bc").distinct()
    test = blocks.orderBy(F.xxhash64("br", "bc", F.lit(seed)), "br", "bc").limit(math.ceil(share * blocks.count()))
    held = keyed.join(test, ["br", "bc"]).select("row", "col", F.lit(True).alias("test"))
    near = dilated(held, buffer, height, width).withColumn("near", F.lit(True))
    out = cells.join(held, ["row", "col"], "left").join(near, ["row", "col"], "left")
    return out.withColumn("part", F.when(F.col("test"), "test").when(F.col("near").isNull(), "train")).drop("test", "near")


def _placed(candidates: DataFrame) -> DataFrame:
    """The candidates that have an id and a place; others take no part."""
    return candidates.where("id is not null and x_m is not null and y_m is not null")


def _distance(x: float, y: float) -> Column:
    return F.sqrt((F.col("x_m") - x) * (F.col("x_m") - x) + (F.col("y_m") - y) * (F.col("y_m") - y))


def _race(share: Column, seed: int, place: int) -> Column:
    """A draw in proportion to a share, as the largest of these over all rows: seeded exponential arrival times, negated."""
    u = (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(place)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.when(share > 0, F.log(u) / share)


def _sequence(candidates: DataFrame, count: int, step: Callable[[int, list[Row]], tuple[DataFrame, Column]], strict: bool = True) -> DataFrame:
    """place, id, x_m, y_m of candidates (id, x_m, y_m) taken one after the other.

    ``step`` gives the rows that may be next and their score; the highest is
    taken, of equal ones the least id. Each step is one aggregate over the
    table, and only the row taken passes the driver.
    """
    chosen: list[Row] = []
    for place in range(count):
        rows, score = step(place, chosen)
        best = rows.where(score.isNotNull()).agg(F.max_by(F.struct("id", "x_m", "y_m"), F.struct(score.alias("score"), (-F.col("id")).alias("order"))).alias("x")).first()["x"]
        if best is None:
            if strict:
                raise ValueError(f"only {len(chosen)} of {count} locations fit")
            break
        chosen.append(best)
    rows = [(k, r["id"], r["x_m"], r["y_m"]) for k, r in enumerate(chosen)]
    return candidates.sparkSession.createDataFrame(rows, "place int, id long, x_m double, y_m double")


def _apart(rows: DataFrame, chosen: list[Row], spacing: float) -> DataFrame:
    for r in chosen:
        rows = rows.where(_distance(r["x_m"], r["y_m"]) >= spacing)
    return rows


def boreholes(candidates: DataFrame, count: int, margin: float, spacing: float, seed: int) -> DataFrame:
    """Uniform draws within a margin of the candidates' extent and no nearer to each other than the spacing; raises if they don't fit."""
    candidates = _placed(candidates)
    e = candidates.agg(*(f(c) for c in ("x_m", "y_m") for f in (F.min, F.max))).first()
    if e[0] is None:
        raise ValueError(f"only 0 of {count} locations fit")
    inside = candidates.where(F.col("x_m").between(e[0] + margin, e[1] - margin) & F.col("y_m").between(e[2] + margin, e[3] - margin))
    return _sequence(candidates, count, lambda place, chosen: (_apart(inside, chosen, spacing), _race(F.lit(1.0), seed, place)))


def farthest_points(candidates: DataFrame, count: int) -> DataFrame:
    """Nested maximin order from the least id: each next candidate is the farthest from those before; ends at candidates that are all taken."""
    candidates = _placed(candidates)

    def step(place, chosen):
        if not chosen:
            return candidates, -F.col("id").cast("double")
        near = [_distance(r["x_m"], r["y_m"]) for r in chosen]
        far = near[0] if len(near) == 1 else F.least(*near)
        return candidates.where(far > 0), far

    return _sequence(candidates, count, step)


def variance_locations(candidates: DataFrame, count: int, sigma: float, length: float, seed: int, floor: float = 1e-9) -> DataFrame:
    """Nested draw in proportion to the kriging variance that those before leave; stops where it is used up."""
    candidates = _placed(candidates)
    rows = candidates.select("id", "x_m", "y_m")

    def step(place, chosen):
        left = rows.withColumn("variance", F.lit(sigma * sigma))
        if chosen:
            known = Kriging.fit([(r["x_m"], r["y_m"]) for r in chosen], [0.0] * len(chosen), sigma, length, mean=0.0)
            left = known.map(rows, places=True)
        return left.where(F.col("variance") > floor), _race(F.col("variance"), seed, place)

    return _sequence(candidates, count, step, strict=False)


def weighted_locations(candidates: DataFrame, weight: Column, count: int, spacing: float, explore: float, seed: int) -> DataFrame:
    """Sequential draw by weight mixed with a share of uniform exploration; chosen ones block their surroundings."""
    candidates = _placed(candidates)
    rows = candidates.withColumn("_weight", F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0)))

    def step(place, chosen):
        free = _apart(rows, chosen, spacing)
        n, total = free.agg(F.count("*"), F.sum("_weight")).first()
        share = (1 - explore) * (F.col("_weight") / total if total else F.lit(1.0 / max(n, 1))) + explore / max(n, 1)
        return free, _race(share, seed, place)

    return _sequence(candidates, count, step)
