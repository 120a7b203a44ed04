"""Queries of geometry, spatial joins and variograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.operators import spatial as P
from gridweave.plans.registry import query

@query("crop_center", "-- doubles: value\nselect sample_id, row - 1 as row, col - 2 as col, value from fields_long where row between 1 and 5 and col between 2 and 5", "fields_long")
def crop_center(v):
    return P.crop_center(v.fields_long, 8, 8, 5, 4)


@query("stride_decimate", "-- doubles: value\nselect * from fields_long where row % 2 = 0 and col % 2 = 0", "fields_long")
def stride_decimate(v):
    return v.fields_long.where("row % 2 = 0 and col % 2 = 0")


_D4 = [("identity", "row", "col"), ("flip_y", "7 - row", "col"), ("flip_x", "row", "7 - col"), ("rotate_180", "7 - row", "7 - col"), ("transpose", "col", "row"),
       ("transpose_flip_y", "7 - col", "row"), ("transpose_flip_x", "col", "7 - row"), ("transpose_rotate_180", "7 - col", "7 - row")]
_ORIENTED = " union all ".join(f"select '{n}' as transform, sample_id, {r} as row, {c} as col, value from fields_long" for n, r, c in _D4)


def _oriented(v, fields):
    out = None
    for name in P.D4:
        one = P.orient(fields, name, 8, 8).withColumn("transform", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("orient_d4", f"-- doubles: value\n{_ORIENTED}", "fields_long")
def orient_d4(v):
    return _oriented(v, v.fields_long)


@query("orient_d4_inverse", "-- doubles: value\nselect n as transform, sample_id, row, col, value from fields_long, (select unnest(%s) as n)" % [n for n, *_ in _D4], "fields_long")
def orient_d4_inverse(v):
    fields, out = v.fields_long, None
    for name in P.D4:
        one = P.orient_inverse(P.orient(fields, name, 8, 8), name, 8, 8).withColumn("transform", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "orientation_ranking",
    f"""-- doubles: rmse bias
    with o as ({_ORIENTED}) select transform, sqrt(avg((o.value - r.value) * (o.value - r.value))) as rmse, avg(o.value - r.value) as bias,
      row_number() over (order by sqrt(avg((o.value - r.value) * (o.value - r.value))), transform)::int as rank
    from o join reference_field r on o.row = r.row and o.col = r.col where o.sample_id = 1 group by transform""",
    "fields_long reference_field",
)
def orientation_ranking(v):
    from pyspark.sql import Window as W

    ref = v.reference_field.withColumnRenamed("value", "reference")
    d = F.col("value") - F.col("reference")
    out = _oriented(v, v.fields_long.where("sample_id = 1")).join(ref, ["row", "col"]).groupBy("transform").agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("bias"))
    return out.withColumn("rank", F.row_number().over(W.orderBy("rmse", "transform")))


@query("coarsen_geometric", "-- doubles: value\nselect sample_id, (row // 2)::int as row, (col // 2)::int as col, avg(value) as value from log_k group by all", "log_k")
def coarsen_geometric(v):
    return P.coarsened(v.log_k, 2)


@query("coarsen_log_median", "-- doubles: value\nselect sample_id, (row // 4)::int as row, (col // 4)::int as col, median(value) as value from log_k group by all", "log_k")
def coarsen_log_median(v):
    return P.coarsened(v.log_k, 4, "median")


@query(
    "join_lag_shift",
    """-- doubles: value other
    select a.sample_id, a.row, a.col, a.value, b.value as other from fields_long a join fields_long b on a.sample_id = b.sample_id and b.row = a.row + 1 and b.col = a.col + 2""",
    "fields_long",
)
def join_lag_shift(v):
    return P.lag_pairs(v.fields_long, 1, 2)


def _variograms(name: str, directions: dict, lags: list[int], by: tuple[str, ...] = ()) -> None:
    rows = ", ".join(f"('{n}', {k}, {k * r}, {k * c}, sqrt({(k * r) ** 2 + (k * c) ** 2}.0::double))" for n, (r, c) in directions.items() for k in lags)
    keys = "".join(f"a.{b}, " for b in by)
    sql = f"""-- doubles: distance gamma correlation
    with o as (select * from (values {rows}) t(direction, lag, dr, dc, distance))
    select {keys}o.direction, o.lag, o.distance, count(*) as pairs, avg((a.value - b.value) * (a.value - b.value)) / 2 as gamma, corr(a.value, b.value) as correlation
    from fields_long a, o join fields_long b on a.sample_id = b.sample_id and b.row = a.row + o.dr and b.col = a.col + o.dc group by {keys}o.direction, o.lag, o.distance"""

    @query(name, sql, "fields_long")
    def variograms(v):
        return P.directional_variograms(v.fields_long, directions, lags, by)


_variograms("directional_variogram_grid", {"y": (1, 0), "x": (0, 1), "diagonal": (1, 1)}, [1, 2, 3])
_FOUR = {"row": (1, 0), "column": (0, 1), "diagonal": (1, 1), "antidiagonal": (1, -1)}
_variograms("variogram_four_direction", _FOUR, [1, 2, 4])
_variograms("variogram_both_diagonals", {"positive": (1, 1), "negative": (1, -1)}, [1, 2, 3, 4])


@query(
    "directional_curves_per_field",
    """-- doubles: q05 q50 q95
    with g as (select a.sample_id, o.direction, o.lag, avg((a.value - b.value) * (a.value - b.value)) / 2 as gamma
      from fields_long a, (values ('y', 1, 1, 0), ('y', 2, 2, 0), ('x', 1, 0, 1), ('x', 2, 0, 2)) o(direction, lag, dr, dc)
      join fields_long b on a.sample_id = b.sample_id and b.row = a.row + o.dr and b.col = a.col + o.dc group by all)
    select direction, lag, quantile_cont(gamma, 0.05) as q05, quantile_cont(gamma, 0.5) as q50, quantile_cont(gamma, 0.95) as q95 from g group by direction, lag""",
    "fields_long",
)
def directional_curves_per_field(v):
    own = P.directional_variograms(v.fields_long, {"y": (1, 0), "x": (0, 1)}, [1, 2], ("sample_id",))
    out = own.groupBy("direction", "lag").agg(F.percentile("gamma", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"))
    return out.select("direction", "lag", *(F.col("q")[k].alias(n) for k, n in enumerate(("q05", "q50", "q95"))))


_PAIR = """pairs as (select a.id, b.id as id2, b.x_m - a.x_m as dx, b.y_m - a.y_m as dy, a.log10_k as va, b.log10_k as vb,
  sqrt((b.x_m - a.x_m) * (b.x_m - a.x_m) + (b.y_m - a.y_m) * (b.y_m - a.y_m)) as distance from good_points a join good_points b on a.id < b.id
  where (b.x_m - a.x_m) * (b.x_m - a.x_m) + (b.y_m - a.y_m) * (b.y_m - a.y_m) <= 360000)"""


def _values(v):
    return v.good_points.select("id", "x_m", "y_m", F.col("log10_k").alias("value"))


@query("join_pairs_theta", f"-- doubles: distance\nwith {_PAIR} select id, id2, distance from pairs where distance <= 600", "good_points", rounds=True)
def join_pairs_theta(v):
    return P.pair_distances(_values(v), 600.0, digits=6)


@query(
    "point_variogram",
    f"""-- doubles: mean_lag gamma
    with {_PAIR}, d as (select *, degrees(atan2(abs(dy), abs(dx))) as angle from pairs where distance <= 600 and distance > 0),
    n as (select 'x' as direction, * from d where angle <= 22.5 union all select 'y', * from d where angle >= 67.5
      union all select 'diagonal', * from d where abs(angle - 45) < 22.5 and dx * dy > 0)
    select direction, floor(distance / 100)::bigint as bin, count(*) as pairs, avg(distance) as mean_lag, avg((va - vb) * (va - vb)) / 2 as gamma from n group by all""",
    "good_points",
)
def point_variogram(v):
    return P.point_variogram(_values(v), 600.0, 100.0)


@query(
    "join_point_to_grid_nearest",
    """select id, round_even(x_m / 100, 0)::int as ix, round_even(y_m / 100, 0)::int as iy,
      round_even(x_m / 100, 0) between 10 and 99 and round_even(y_m / 100, 0) between 10 and 99 and (round_even(x_m / 100, 0) + round_even(y_m / 100, 0)) % 3 > 0 as active from points""",
    "points",
)
def join_point_to_grid_nearest(v):
    line = v.spark.range(10, 100)
    mask = line.select(F.col("id").cast("int").alias("ix"), F.explode(F.sequence(F.lit(10), F.lit(99))).alias("iy"))
    mask = mask.withColumn("active", (F.col("ix") + F.col("iy")) % 3 > 0)
    return P.to_nearest_cell(v.points.select("id", "x_m", "y_m"), mask, 0.0, 0.0, 100.0).select("id", "ix", "iy", "active")


def _bilinear_sql(clamp: bool) -> str:
    move = "least(greatest({0} / 1600, 0), 7)" if clamp else "{0} / 1600"
    return f"""-- doubles: sampled
    with g as (select id, {move.format("x_m")} as gx, {move.format("y_m")} as gy from points),
    c as (select id, floor(gy)::int + i as row, floor(gx)::int + j as col, (case when i = 1 then gy - floor(gy) else 1 - (gy - floor(gy)) end)
      * (case when j = 1 then gx - floor(gx) else 1 - (gx - floor(gx)) end) as weight from g, (values (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j))
    select c.id, case when count(r.value) = count(*) then sum(r.value * weight) end as sampled
    from c left join reference_field r on c.row = r.row and c.col = r.col where weight > 0 group by c.id"""


@query("join_point_bilinear", _bilinear_sql(False), "points reference_field")
def bilinear(v):
    return P.bilinear(v.points.select("id", "x_m", "y_m"), v.reference_field, 0.0, 0.0, 1600.0).select("id", "sampled")


@query("join_grid_bilinear_mean", _bilinear_sql(True), "points reference_field")
def join_grid_bilinear_mean(v):
    return P.bilinear(v.points.select("id", "x_m", "y_m"), v.reference_field, 0.0, 0.0, 1600.0, clamp=(7.0, 7.0)).select("id", "sampled")


@query("block_key", "select id, floor((x_m - 100) / 1500)::int as bx, floor((y_m - 200) / 1500)::int as by from points", "points")
def block_key(v):
    return P.block_key(v.points, 1500.0, 100.0, 200.0).select("id", "bx", "by")


for _name in ("distinct_blocks", "distinct_cells"):

    @query(_name, "select distinct floor(x_m / 1500)::int as bx, floor(y_m / 1500)::int as by from points", "points")
    def distinct_blocks(v):
        return P.block_key(v.points, 1500.0).select("bx", "by").distinct()


@query(
    "join_exclusion_buffer",
    """with blocks as (select distinct floor(x_m / 1500)::int as bx, floor(y_m / 1500)::int as b2 from points where (floor(x_m / 1500) + 3 * floor(y_m / 1500))::int % 7 = 0)
    select id from points p where not exists (select 1 from blocks b where p.x_m >= bx * 1500 - 400 and p.x_m < (bx + 1) * 1500 + 400 and p.y_m >= b2 * 1500 - 400 and p.y_m < (b2 + 1) * 1500 + 400)""",
    "points",
)
def join_exclusion_buffer(v):
    blocks = P.block_key(v.points, 1500.0).select("bx", "by").distinct().where("(bx + 3 * by) % 7 = 0")
    return P.buffered_training(v.points, blocks, 1500.0, 400.0).select("id")


@query(
    "join_buffer_dilate",
    "select distinct r.row, r.col from reference_field r join reference_field t on abs(r.row - t.row) <= 1 and abs(r.col - t.col) <= 1 and t.row = t.col and t.row % 4 = 0",
    "reference_field",
)
def join_buffer_dilate(v):
    return P.dilated(v.reference_field.where("row = col and row % 4 = 0"), 1, 8, 8)


@query(
    "join_nearest_train_distance",
    """-- doubles: distance
    select a.id, min(sqrt((a.x_m - b.x_m) * (a.x_m - b.x_m) + (a.y_m - b.y_m) * (a.y_m - b.y_m))) as distance from points a, points b where a.id % 10 = 0 and b.id % 10 <> 0 group by a.id""",
    "points",
)
def join_nearest_train_distance(v):
    return P.nearest_distance(v.points.where("id % 10 = 0"), v.points.where("id % 10 <> 0"))


@query(
    "select_domain_max_count",
    """-- doubles: wx wy
    with w as (select i * 400.0::double as wx, j * 400.0::double as wy from range(-4, 33) a(i), range(-4, 33) b(j)),
    c as (select wx, wy, count(*) as n, avg(x_m) as cx, avg(y_m) as cy from w join points on x_m >= wx and x_m < wx + 1600 and y_m >= wy and y_m < wy + 1600 group by wx, wy)
    select wx, wy, n from c order by n desc, (cx - (wx + 800)) * (cx - (wx + 800)) + (cy - (wy + 800)) * (cy - (wy + 800)), wx, wy limit 1""",
    "points",
)
def select_domain_max_count(v):
    return P.domain_by_count(v.points, 1600.0, 400.0)


@query("bbox_filter", "select id, x_m >= 3000 and x_m < 9000 and y_m >= 2000 and y_m < 8000 as kept from points", "points")
def bbox_filter(v):
    x, y = F.col("x_m"), F.col("y_m")
    return v.points.select("id", ((x >= 3000) & (x < 9000) & (y >= 2000) & (y < 8000)).alias("kept"))


@query("domain_contains", "select id from points where x_m between 3000 and 9000 and y_m between 2000 and 8000", "points")
def domain_contains(v):
    return v.points.where("x_m between 3000 and 9000 and y_m between 2000 and 8000").select("id")


@query("withheld_mask", "select row, col from reference_field where not (row = col and row % 2 = 0)", "reference_field")
def withheld_mask(v):
    observed = v.reference_field.where("row = col and row % 2 = 0").select("row", "col")
    return v.reference_field.select("row", "col").join(observed, ["row", "col"], "left_anti")


@query(
    "probe_stencil",
    "select distinct least(greatest(r, 0), 7)::int as row, least(greatest(c, 0), 7)::int as col from (select floor(y_m / 1600)::int + d as r, floor(x_m / 1600)::int - d as c from points, range(-2, 3) b(d) where k > 0.9)",
    "points",
)
def probe_stencil(v):
    """Cells on the falling diagonals about the points of the largest values, moved onto the grid."""
    clip = lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(7)).cast("int")
    out = v.points.where("k > 0.9").select(F.floor(F.col("y_m") / 1600).alias("r"), F.floor(F.col("x_m") / 1600).alias("c"), F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("d"))
    return out.select(clip(F.col("r") + F.col("d")).alias("row"), clip(F.col("c") - F.col("d")).alias("col")).distinct()


@query(
    "georef_search",
    """-- doubles: rmse
    select dr, dc, sqrt(avg((a.value - r.value) * (a.value - r.value))) as rmse, count(*) as overlap from (select * from fields_long where sample_id = 1) a,
      range(-2, 3) x(dr), range(-2, 3) y(dc) join reference_field r on r.row = a.row + dr and r.col = a.col + dc group by dr, dc order by rmse, dr, dc limit 5""",
    "fields_long reference_field",
)
def georef_search(v):
    """Offsets of a field on the reference, by RMSE of the overlap; the best five."""
    d = F.explode(F.array(*(F.struct(F.lit(i).cast("bigint").alias("dr"), F.lit(j).cast("bigint").alias("dc")) for i in range(-2, 3) for j in range(-2, 3))))
    moved = v.fields_long.where("sample_id = 1").select("row", "col", "value", d.alias("o")).select("o.dr", "o.dc", (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"), "value")
    e = F.col("value") - F.col("reference")
    out = moved.join(v.reference_field.withColumnRenamed("value", "reference"), ["row", "col"]).groupBy("dr", "dc").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.count("*").alias("overlap"))
    return out.orderBy("rmse", "dr", "dc").limit(5)


@query("to_2d", "select count(*) = 64 * count(distinct sample_id) as complete from fields_long", "fields_long")
def to_2d(v):
    return v.fields_long.agg((F.count("*") == 64 * F.count_distinct("sample_id")).alias("complete"))


def _axis(name, cells, to_cells, step):
    return f"""{name} as (select k::int as k, least(floor(pos), {cells - 2})::int + o as source, case o when 0 then 1 - (pos - least(floor(pos), {cells - 2})) else pos - least(floor(pos), {cells - 2}) end as w
      from (select k, (k + 0.5::double) * {step}::double as pos from range({to_cells}) t(k)), (select unnest([0, 1]) as o))"""


@query(
    "historical_interpolate",
    f"""-- doubles: value
    with {_axis("a", 8, 16, 0.5)} select sample_id, y.k as row, x.k as col, sum(pow(10.0::double, value) * x.w * y.w) as value
    from fields_long f join a x on x.source = f.row join a y on y.source = f.col group by sample_id, y.k, x.k""",
    "fields_long",
)
def historical_interpolate(v):
    """Every field on a grid of twice its resolution, linear between its nodes."""
    return P.resampled_window(v.fields_long.withColumn("value", F.pow(F.lit(10.0), "value")), (8, 8), 20.0, 10.0, (16, 16))


@query(
    "historical_reconstruct",
    f"""-- doubles: value
    with {_axis("a", 6, 12, 0.5)}, w as (select sample_id, 6 - col as row, row - 1 as col, pow(10.0::double, value) as value from fields_long where row between 1 and 6 and col between 1 and 6)
    select sample_id, y.k as row, x.k as col, case when sum(w.value * x.w * y.w) > 0 then log10(sum(w.value * x.w * y.w) * 7.5e6::double) end as value from w join a x on x.source = w.row join a y on y.source = w.col group by sample_id, y.k, x.k""",
    "fields_long",
)
def historical_reconstruct(v):
    """The turned window of every field, on a grid of twice its resolution, converted by the historical divisor; null where the slope beyond the last node leads below 0."""
    from gridweave.functions import scalars as S

    w = v.fields_long.where("row between 1 and 6 and col between 1 and 6").withColumns({"row": F.col("row") - 1, "col": F.col("col") - 1})
    turned = P.orient(w, "transpose_flip_y", 6, 6).withColumn("value", F.pow(F.lit(10.0), "value"))
    fine = P.resampled_window(turned, (6, 6), 20.0, 10.0, (12, 12))
    return fine.withColumn("value", F.when(F.col("value") > 0, F.log10(F.col("value") * S.HISTORICAL_DIVISOR)))
