"""Values of a north-up raster at points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def raster_samples(points: DataFrame, raster: DataFrame, transform: tuple[float, float, float, float, float, float], height: int, width: int) -> DataFrame:
    """id, linear, nearest, linear_valid, nearest_valid of each point (id, x_m, y_m), by pixel centres of a raster (row, col, value).

    transform: a, b, c, d, e, f of x = a * col + b * row + c and y = d * col + e * row + f
    at a pixel's corner; rotation and shear are refused. Points outside the
    outermost centres have no value. A value is valid if it is finite and above
    0. A missing, null or non-finite pixel leaves points without a value that
    its weight reaches; a point half-way between two pixels takes the lower row
    or column as the nearest. Points without a place keep their row, repeated
    points repeat; of repeated pixels the greatest value counts.

    Every four neighbouring pixels become one row by a shuffle of the raster,
    and points meet it by an equi-join, so neither side is sent to all tasks.
    """
    a, b, c, d, e, f = map(float, transform)
    if abs(b) > 1e-12 or abs(d) > 1e-12 or abs(a) < 1e-12 or abs(e) < 1e-12:
        raise ValueError("a raster has to be north-up, without rotation and shear")
    if height < 2 or width < 2:
        raise ValueError("a raster has two rows and columns at least")
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    spread = raster.select("row", "col", F.col("value").cast("double").alias("value"), corner.alias("o"))
    spread = spread.select((F.col("row") - F.col("o.i")).alias("_r"), (F.col("col") - F.col("o.j")).alias("_c"), "o", "value")
    inside = (F.col("_r").between(0, height - 2)) & (F.col("_c").between(0, width - 2))
    at = lambda i, j: F.max(F.when((F.col("o.i") == i) & (F.col("o.j") == j), F.col("value"))).alias(f"_v{i}{j}")
    fours = spread.where(inside).groupBy("_r", "_c").agg(*(at(i, j) for i in (0, 1) for j in (0, 1)))

    placed = points.select("id", ((F.col("y_m") - f) / e - 0.5).alias("_y"), ((F.col("x_m") - c) / a - 0.5).alias("_x"))
    reached = F.col("_y").between(0, height - 1) & F.col("_x").between(0, width - 1)
    cell = lambda p, n: F.when(reached, F.least(F.floor(p), F.lit(n - 2)).cast("int"))
    placed = placed.withColumns({"_r": cell("_y", height), "_c": cell("_x", width)})
    met = placed.join(fours, ["_r", "_c"], "left").withColumns({"_u": F.col("_y") - F.col("_r"), "_w": F.col("_x") - F.col("_c")})

    def weighed(i: int, j: int) -> Column:
        weight = (F.col("_u") if i else 1 - F.col("_u")) * (F.col("_w") if j else 1 - F.col("_w"))
        return F.when(weight == 0, F.lit(0.0)).otherwise(weight * F.col(f"_v{i}{j}"))

    linear = weighed(0, 0) + weighed(0, 1) + weighed(1, 0) + weighed(1, 1)
    near = lambda i: F.when(F.col("_w") > 0.5, F.col(f"_v{i}1")).otherwise(F.col(f"_v{i}0"))
    nearest = F.when(F.col("_u") > 0.5, near(1)).otherwise(near(0))
    finite = lambda v: F.when(F.abs(v) < float("inf"), v)
    out = met.select("id", finite(linear).alias("linear"), finite(nearest).alias("nearest"))
    return out.withColumns({f"{n}_valid": F.coalesce(F.col(n) > 0, F.lit(False)) for n in ("linear", "nearest")})
