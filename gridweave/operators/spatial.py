"""Geometry of gridded fields, spatial joins and variograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from gridweave.functions.scalars import nearest_index


def crop_center(fields: DataFrame, height: int, width: int, h: int, w: int) -> DataFrame:
    """The centred window, with its own origin."""
    r0, c0 = (height - h) // 2, (width - w) // 2
    inside = F.col("row").between(r0, r0 + h - 1) & F.col("col").between(c0, c0 + w - 1)
    return fields.where(inside).withColumns({"row": F.col("row") - r0, "col": F.col("col") - c0})


#: New row and column of a cell under the eight symmetries of the square, as (transposed, row flipped, column flipped).
D4 = {
    "identity": (False, False, False), "flip_y": (False, True, False), "flip_x": (False, False, True), "rotate_180": (False, True, True),
    "transpose": (True, False, False), "transpose_flip_y": (True, True, False), "transpose_flip_x": (True, False, True), "transpose_rotate_180": (True, True, True),
}
_INVERSE = {"transpose_flip_y": "transpose_flip_x", "transpose_flip_x": "transpose_flip_y"}


def orient(fields: DataFrame, transform: str, height: int, width: int) -> DataFrame:
    """A symmetry of the square: transposition first, then flips."""
    turned, flip_r, flip_c = D4[transform]
    r, c = (F.col("col"), F.col("row")) if turned else (F.col("row"), F.col("col"))
    h, w = (width, height) if turned else (height, width)
    return fields.withColumns({"row": (h - 1 - r) if flip_r else r, "col": (w - 1 - c) if flip_c else c})


def orient_inverse(fields: DataFrame, transform: str, height: int, width: int) -> DataFrame:
    return orient(fields, _INVERSE.get(transform, transform), height, width)


def coarsened(fields: DataFrame, factor: int, how: str = "mean") -> DataFrame:
    """Block mean or median of logarithms; a remainder at the edges makes a smaller block."""
    of = {"mean": F.avg, "median": F.median}[how]
    block = [F.floor(F.col(x) / factor).cast("int").alias(x) for x in ("row", "col")]
    return fields.groupBy("sample_id", *block).agg(of("value").alias("value"))


def lag_pairs(fields: DataFrame, dr: int, dc: int) -> DataFrame:
    """Cells with the cell at an offset: value, other."""
    there = fields.select("sample_id", (F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.col("value").alias("other"))
    return fields.join(there.hint("merge"), ["sample_id", "row", "col"])


def directional_variograms(fields: DataFrame, directions: dict[str, tuple[int, int]], lags: list[int], by: tuple[str, ...] = ()) -> DataFrame:
    """direction, lag, distance, pairs, gamma, correlation at all given lags, in one self-join.

    Each cell meets its partners by exploded offsets, so the join is an equi-join.
    Both sides are as long as the fields, however small their file is, so both
    are shuffled and none is sent to every task; an offset goes by its number.
    """
    offsets = [(n, k, k * dr, k * dc, k * math.hypot(dr, dc)) for n, (dr, dc) in directions.items() for k in lags]
    each = F.explode(F.array(*(F.struct(F.lit(o).alias("offset"), F.lit(r).alias("dr"), F.lit(c).alias("dc")) for o, (_, _, r, c, _) in enumerate(offsets))))
    here = fields.select("sample_id", "row", "col", "value", each.alias("o")).select(
        "sample_id", (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"), "value", "o.offset"
    )
    both = here.join(fields.withColumnRenamed("value", "other").hint("merge"), ["sample_id", "row", "col"])
    d = F.col("value") - F.col("other")
    found = both.groupBy(*by, "offset").agg(F.count("*").alias("pairs"), (F.avg(d * d) / 2).alias("gamma"), F.corr("value", "other").alias("correlation"))
    names = F.array(*(F.struct(F.lit(n).alias("direction"), F.lit(k).alias("lag"), F.lit(float(d)).alias("distance")) for n, k, _, _, d in offsets))
    return found.withColumn("o", names[F.col("offset")]).select(*by, "o.direction", "o.lag", "o.distance", "pairs", "gamma", "correlation")


#: A block, and those of the eight around it that come after it.
_ONWARD = ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))


#: Ids of a place that are one array at most, about, and points to a task of the pairs of places.
IDS, PAIR_POINTS = 1024, 25_000


def place_pairs(places: DataFrame, max_lag: float, tasks: int | None = None) -> DataFrame:
    """Unordered pairs of different places (x_m, y_m once each, more columns) no further apart than max_lag: their columns, the partner's with a 2, dx, dy, distance.

    Places meet in square buckets as wide as max_lag: each stands in its own,
    its partners are looked for in that and in half of those around, as the
    other half looks for it. No place meets all others, and neither side is
    sent to every task. tasks: into how many buckets are dealt, whatever
    their size: that is for rows that stand for many.
    """
    own = places.where("x_m is not null and y_m is not null").withColumns({"bx": F.floor(F.col("x_m") / max_lag), "by": F.floor(F.col("y_m") / max_lag)})
    onward = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _ONWARD)))
    named = {c: {"x_m": "x2", "y_m": "y2"}.get(c, f"{c}2") for c in places.columns}
    other = own.select(*(F.col(c).alias(n) for c, n in named.items()), "bx", "by", onward.alias("o"))
    other = other.select(*named.values(), (F.col("bx") + F.col("o.i")).alias("bx"), (F.col("by") + F.col("o.j")).alias("by"), ((F.col("o.i") != 0) | (F.col("o.j") != 0)).alias("_apart"))
    dx, dy = F.col("x2") - F.col("x_m"), F.col("y2") - F.col("y_m")
    if tasks:
        own, other = (x.repartition(tasks, "bx", "by") for x in (own, other))
    met = own.join(other.hint("merge"), ["bx", "by"]).where(F.col("_apart") | (F.struct("x_m", "y_m") < F.struct("x2", "y2")))
    return met.withColumns({"dx": dx, "dy": dy, "distance": F.sqrt(dx * dx + dy * dy)}).where(F.col("distance") <= max_lag).drop("bx", "by", "_apart")


def point_pairs(points: DataFrame, max_lag: float) -> DataFrame:
    """Unordered pairs (id < id2) of points (id, x_m, y_m, value) no further apart than max_lag.

    Places are paired first, then each pair of places gets its points. The
    result has a row for each pair of points: that is what is asked for.
    """
    places = points.where("x_m is not null and y_m is not null").select("x_m", "y_m").distinct()
    same = places.select("x_m", "y_m", F.col("x_m").alias("x2"), F.col("y_m").alias("y2"), F.lit(True).alias("same"))
    near = place_pairs(places, max_lag).select("x_m", "y_m", "x2", "y2", F.lit(False).alias("same")).unionByName(same)
    one = points.select("id", "x_m", "y_m", "value").join(near.hint("merge"), ["x_m", "y_m"])
    two = points.select(F.col("id").alias("id2"), F.col("x_m").alias("x2"), F.col("y_m").alias("y2"), F.col("value").alias("value2"))
    met = one.join(two.hint("merge"), ["x2", "y2"]).where((F.col("id") < F.col("id2")) | (~F.col("same") & (F.col("id") > F.col("id2"))))
    first = F.col("id") < F.col("id2")
    turned = {c: F.when(first, F.col(c)).otherwise(F.col(o)) for a, b in (("id", "id2"), ("x_m", "x2"), ("y_m", "y2"), ("value", "value2")) for c, o in ((a, b), (b, a))}
    dx, dy = F.col("x2") - F.col("x_m"), F.col("y2") - F.col("y_m")
    out = met.select(*(turned[c].alias(c) for c in ("id", "x_m", "y_m", "value", "id2", "x2", "y2", "value2")))
    return out.withColumns({"dx": dx, "dy": dy, "distance": F.sqrt(dx * dx + dy * dy)}).where(F.col("distance") <= max_lag)


def _listed(points: DataFrame, lists: list[str]) -> tuple[DataFrame, int]:
    """x_m, y_m, part and arrays (lists) of what stands at each place, and tasks for their pairs; a place of many points is in parts."""
    points = points.where("x_m is not null and y_m is not null")
    n, most = points.groupBy("x_m", "y_m").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    part = F.pmod(F.xxhash64(*lists), F.lit(most // IDS + 1)).cast("int").alias("part")
    return points.groupBy("x_m", "y_m", part).agg(*(F.collect_list(c).alias(c) for c in lists)), n // PAIR_POINTS + 48


def pair_distances(points: DataFrame, max_lag: float, digits: int | None = None) -> DataFrame:
    """id, id2 (id < id2), distance of points (id, x_m, y_m) no further apart than max_lag, rounded if digits are given.

    Places meet with arrays of their ids, so that a distance is worked out and
    rounded once for a pair of places; rows are made of the arrays at the very
    end. The result has a row for each pair of points: that is what is asked for.
    """
    listed, tasks = _listed(points.select("x_m", "y_m", F.col("id").alias("ids")), ["ids"])
    met = place_pairs(listed, max_lag, tasks).select("ids", "ids2", "distance", F.lit(False).alias("same"))
    again = listed.select("x_m", "y_m", F.col("part").alias("part2"), F.col("ids").alias("ids2"))
    own = listed.join(again.hint("merge"), ["x_m", "y_m"]).where("part <= part2").select("ids", "ids2", F.lit(0.0).alias("distance"), (F.col("part") == F.col("part2")).alias("same"))
    distance = F.col("distance") if digits is None else F.round("distance", digits) + F.lit(0.0)
    both = met.unionByName(own).select("ids2", distance.alias("distance"), "same", F.explode("ids").alias("a"))
    rows = both.select("a", F.explode("ids2").alias("b"), "distance", "same").where((F.col("a") < F.col("b")) | (~F.col("same") & (F.col("a") > F.col("b"))))
    return rows.select(F.least("a", "b").alias("id"), F.greatest("a", "b").alias("id2"), "distance")


def kriging_cross(asked: DataFrame, observed: DataFrame, reach: float, variance: float, length: float, digits: int | None = None) -> DataFrame:
    """id, other, covariance (exponential) of asked points and observations (id, x_m, y_m) no further apart than reach, rounded if digits are given.

    Places meet with arrays of their ids, so that a covariance is worked out
    and rounded once for a pair of places; rows are made of the arrays at the
    very end. The result has a row for each pair of points: that is what is asked for.
    """
    points = asked.select("x_m", "y_m", F.struct("id").alias("ids"), F.lit(None).alias("others"))
    points = points.unionByName(observed.select("x_m", "y_m", F.lit(None).alias("ids"), F.struct("id").alias("others")))
    listed, tasks = _listed(points, ["ids", "others"])
    pair = lambda a, b: F.struct(F.col(a).alias("ids"), F.col(b).alias("others"))
    met = place_pairs(listed, reach, tasks).select("distance", F.explode(F.array(pair("ids", "others2"), pair("ids2", "others"))).alias("p"))
    again = listed.select("x_m", "y_m", F.col("others").alias("others2"))
    own = listed.select("x_m", "y_m", "ids").join(again.hint("merge"), ["x_m", "y_m"]).select(F.lit(0.0).alias("distance"), pair("ids", "others2").alias("p"))
    covariance = variance * F.exp(-F.col("distance") / length)
    covariance = covariance if digits is None else F.round(covariance, digits) + F.lit(0.0)
    both = met.unionByName(own).select(covariance.alias("covariance"), F.col("p.ids.id").alias("ids"), F.col("p.others.id").alias("others"))
    return both.select("covariance", "others", F.explode("ids").alias("id")).select("id", F.explode("others").alias("other"), "covariance")


def point_variogram(points: DataFrame, max_lag: float, bin_m: float, tolerance_deg: float = 22.5, least_pairs: int = 1) -> DataFrame:
    """direction (x, y, diagonal), bin, pairs, mean lag and gamma of points (id, unique; x_m, y_m, value); directions may share pairs at wide tolerances.

    The points of a place are one row with their number, mean and spread, from
    which the squared differences of a pair of places follow exactly: n points
    in p places cost pairs of places, however many points share one.
    """
    moments = [F.count("*").alias("n"), F.count("value").alias("m"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("spread")]
    places = points.where("id is not null").groupBy("x_m", "y_m").agg(*moments)
    pairs = place_pairs(places, max_lag).where("distance > 0")
    angle = F.degrees(F.atan2(F.abs(F.col("dy")), F.abs(F.col("dx"))))
    names = F.array_compact(F.array(
        F.when(angle <= tolerance_deg, "x"), F.when(angle >= 90 - tolerance_deg, "y"),
        F.when((F.abs(angle - 45) < 45 - tolerance_deg) & (F.col("dx") * F.col("dy") > 0), "diagonal"),
    ))
    d, both, known = F.col("mean") - F.col("mean2"), F.col("n") * F.col("n2"), F.col("m") * F.col("m2")
    squares = known * d * d + F.col("m2") * F.col("spread") + F.col("m") * F.col("spread2")
    out = pairs.withColumns({"direction": F.explode(names), "bin": F.floor(F.col("distance") / bin_m)}).groupBy("direction", "bin").agg(
        F.sum(both).alias("pairs"), (F.sum(both * F.col("distance")) / F.sum(both)).alias("mean_lag"), (F.sum(squares) / F.nullif(F.sum(known), F.lit(0)) / 2).alias("gamma")
    )
    return out.where(F.col("pairs") >= least_pairs)


def to_nearest_cell(points: DataFrame, mask: DataFrame, x0: float, y0: float, step: float) -> DataFrame:
    """Points with their cell (ix, iy; halves go to the even one) and whether it is active; outside is inactive."""
    x = points.withColumns({"ix": nearest_index(F.col("x_m"), x0, step), "iy": nearest_index(F.col("y_m"), y0, step)})
    return x.join(mask, ["ix", "iy"], "left").withColumn("active", F.coalesce("active", F.lit(False)))


def bilinear(points: DataFrame, grid: DataFrame, x0: float, y0: float, step: float, clamp: tuple[float, float] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Points with the value interpolated from the four cells around (row, col, value); null outside.

    keys: columns of both tables that cells have to agree in, such as a sample.
    clamp: largest x and y index, to which coordinates are moved first.
    """
    gx, gy = (F.col("x_m") - x0) / step, (F.col("y_m") - y0) / step
    if clamp:
        gx, gy = F.least(F.greatest(gx, F.lit(0.0)), F.lit(clamp[0])), F.least(F.greatest(gy, F.lit(0.0)), F.lit(clamp[1]))
    x = points.withColumns({"_gx": gx, "_gy": gy})
    near = lambda c, k: F.floor(F.col(c)).cast("int") + k
    share = lambda c, k: (F.col(c) - F.floor(F.col(c))) if k else (1 - (F.col(c) - F.floor(F.col(c))))
    corner = lambda i, j: F.struct(near("_gy", i).alias("row"), near("_gx", j).alias("col"), (share("_gy", i) * share("_gx", j)).alias("weight"))
    corners = F.filter(F.array(*(corner(i, j) for i in (0, 1) for j in (0, 1))), lambda c: c["weight"] > 0)
    each = x.withColumn("_c", F.explode(corners)).select(*points.columns, F.col("_c.row").alias("row"), F.col("_c.col").alias("col"), F.col("_c.weight").alias("weight"))
    met = each.join(grid.withColumnRenamed("value", "_v"), [*keys, "row", "col"], "left")
    inside = F.count("_v") == F.count("*")
    return met.groupBy(*points.columns).agg(F.when(inside, F.sum(F.col("_v") * F.col("weight"))).alias("sampled"))


def block_key(points: DataFrame, size: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    return points.withColumns({"bx": F.floor((F.col("x_m") - x0) / size).cast("int"), "by": F.floor((F.col("y_m") - y0) / size).cast("int")})


def buffered_training(points: DataFrame, blocks: DataFrame, size: float, buffer_m: float) -> DataFrame:
    """Points outside every test block (bx, by) grown by the buffer; half-open rectangles.

    Blocks that a point can touch are few, so it looks them up by key.
    """
    reach = math.ceil(buffer_m / size)
    around = range(-reach, reach + 1)
    own = block_key(points, size)
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in around for j in around)))
    near = own.withColumn("o", each).select(*points.columns, (F.col("bx") + F.col("o.i")).alias("bx"), (F.col("by") + F.col("o.j")).alias("by")).join(blocks, ["bx", "by"])
    touch = lambda v, b: (F.col(v) >= F.col(b) * size - buffer_m) & (F.col(v) < (F.col(b) + 1) * size + buffer_m)
    hit = near.where(touch("x_m", "bx") & touch("y_m", "by")).select("id").distinct()
    return points.join(hit, "id", "left_anti")


def dilated(cells: DataFrame, by: int, height: int, width: int) -> DataFrame:
    """Cells within a Chebyshev distance of given ones, on the grid."""
    steps = range(-by, by + 1)
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in steps for j in steps)))
    out = cells.select("row", "col", each.alias("o")).select((F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"))
    return out.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).distinct()


def domain_by_count(points: DataFrame, window: float, step: float) -> DataFrame:
    """The window on a lattice with most points: then nearest to their centre, then west, then south.

    A point is sent to the lattice windows that hold it, so windows are
    counted by key.
    """
    reach = int(window // step)
    at = lambda c: F.floor(F.col(c) / step).cast("int")
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(reach + 1) for j in range(reach + 1))))
    held = points.withColumn("o", each).withColumns({"wx": (at("x_m") - F.col("o.i")) * step, "wy": (at("y_m") - F.col("o.j")) * step})
    inside = (F.col("x_m") >= F.col("wx")) & (F.col("x_m") < F.col("wx") + window) & (F.col("y_m") >= F.col("wy")) & (F.col("y_m") < F.col("wy") + window)
    count = held.where(inside).groupBy("wx", "wy").agg(F.count("*").alias("n"), F.avg("x_m").alias("cx"), F.avg("y_m").alias("cy"))
    mid = lambda c, w: F.col(c) - (F.col(w) + window / 2)
    return count.withColumn("offset2", mid("cx", "wx") * mid("cx", "wx") + mid("cy", "wy") * mid("cy", "wy")).orderBy(F.desc("n"), "offset2", "wx", "wy").limit(1).select("wx", "wy", "n")


def nearest_distance(test: DataFrame, train: DataFrame) -> DataFrame:
    """id and the distance to the nearest training point; null coordinates have none and training points without one don't count.

    Points meet in blocks. A distance found in the nine blocks around a point
    is right if it is no longer than a block's side; points without such a
    one look again in blocks of four times the side.
    """
    place = ["x_m", "y_m"]
    train = train.select(*(F.col(c).alias(f"_{c}") for c in place)).where("_x_m is not null and _y_m is not null").distinct()
    ends = [f(c) for c in ("_x_m", "_y_m") for f in (F.min, F.max)]
    n, *edges = train.agg(F.count("*"), *ends).first()
    every = test.select("id", *place)
    if not n:
        return every.where("false").select("id", F.lit(0.0).alias("distance"))
    far = every.agg(*(f(c) for c in place for f in (F.min, F.max))).first()
    lows, highs = ([min(x for x in (edges[k], far[k]) if x is not None) for k in (0, 2)], [max(x for x in (edges[k], far[k]) if x is not None) for k in (1, 3)])
    longest = math.hypot(highs[0] - lows[0], highs[1] - lows[1]) + 1e-9
    size = max(longest / math.sqrt(n), longest * 1e-6)
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    left, out = every.where("x_m is not null and y_m is not null").distinct(), None
    while True:
        block = lambda c, s=size: F.floor(F.col(c) / s)
        known = train.withColumns({"bx": block("_x_m"), "by": block("_y_m")})
        asked = left.withColumns({"o": around, "cx": block("x_m"), "cy": block("y_m")}).select("id", *place, (F.col("cx") + F.col("o.i")).alias("bx"), (F.col("cy") + F.col("o.j")).alias("by"))
        d = F.sqrt((F.col("x_m") - F.col("_x_m")) * (F.col("x_m") - F.col("_x_m")) + (F.col("y_m") - F.col("_y_m")) * (F.col("y_m") - F.col("_y_m")))
        found = asked.join(known, ["bx", "by"]).groupBy("id", *place).agg(F.min(d).alias("distance")).where(F.col("distance") <= size).persist()
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select("id", *place), ["id", *place], "left_anti")
        if size > longest or left.isEmpty():
            break
        size *= 4
    return every.select("id").distinct().join(out.groupBy("id").agg(F.min("distance").alias("distance")), "id", "left")


def unordered(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b), F.greatest(a, b))


def axis_weights(spark, cells: int, resolution: float, to_resolution: float, to_cells: int) -> DataFrame:
    """to, source, weight along an axis: each new cell's centre between two of the old nodes, which stand at 0, 1, ... times the resolution.

    Centres beyond the last node go on with the slope of the last two.
    """
    at = (F.col("id") + 0.5) * float(to_resolution) / float(resolution)
    first = F.least(F.floor(at), F.lit(cells - 2)).cast("int")
    pair = F.array(F.struct(first.alias("source"), (1 - (at - first)).alias("weight")), F.struct((first + 1).alias("source"), (at - first).alias("weight")))
    return spark.range(to_cells).select(F.col("id").cast("int").alias("to"), F.explode(pair).alias("p")).select("to", "p.source", "p.weight")


def resampled_window(fields: DataFrame, shape: tuple[int, int], resolution: float, to_resolution: float, to_shape: tuple[int, int]) -> DataFrame:
    """sample_id, row, col, value of all fields, linear between their nodes, at the centres of another grid.

    A window's first axis is x: its rows become the new grid's columns. Old
    nodes meet new cells by their index, so nothing but two short tables of
    weights, one an axis, is sent to the tasks.
    """
    spark = fields.sparkSession
    along_x = axis_weights(spark, shape[0], resolution, to_resolution, to_shape[1]).select(F.col("to").alias("to_col"), F.col("source").alias("row"), F.col("weight").alias("wx"))
    along_y = axis_weights(spark, shape[1], resolution, to_resolution, to_shape[0]).select(F.col("to").alias("to_row"), F.col("source").alias("col"), F.col("weight").alias("wy"))
    met = fields.join(F.broadcast(along_x), "row").join(F.broadcast(along_y), "col")
    out = met.groupBy("sample_id", F.col("to_row").alias("row"), F.col("to_col").alias("col"))
    return out.agg(F.sum(F.col("value") * F.col("wx") * F.col("wy")).alias("value"))
