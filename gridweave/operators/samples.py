"""Quantities of each sample over its cells, and of each field's shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridweave.functions.scalars import safe_divide


def roi(fields: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """Rows of a half-open window."""
    return fields.where((F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1))


def mean_anomaly(fields: DataFrame, background: float) -> DataFrame:
    return fields.groupBy("sample_id").agg(F.avg(F.col("value") - background).alias("mean_anomaly"))


def receptors(fields: DataFrame, cells: list[tuple[int, int]]) -> DataFrame:
    """One row a sample, one column a receptor: receptor_001, ..."""
    at = lambda r, c: F.max(F.when((F.col("row") == r) & (F.col("col") == c), F.col("value")))
    inside = F.lit(False)
    for r, c in cells:
        inside = inside | ((F.col("row") == r) & (F.col("col") == c))
    return fields.where(inside).groupBy("sample_id").agg(*(at(r, c).alias(f"receptor_{k:03d}") for k, (r, c) in enumerate(cells, 1)))


def warming(fields: DataFrame, background: float, threshold: float, cell_m: float) -> DataFrame:
    """Largest anomaly, and the area of cells that warm by more than the threshold."""
    delta = F.col("value") - background
    return fields.groupBy("sample_id").agg(
        F.max(delta).alias("max_anomaly"),
        (F.count_if(delta.cast("float") > F.lit(threshold).cast("float")) * cell_m * cell_m).alias("area_m2"),
    )


def regional_deviation(fields: DataFrame, reference: DataFrame) -> DataFrame:
    """max |d|, RMS and mean of d against a reference (row, col, reference)."""
    d = F.col("value") - F.col("reference")
    return fields.join(reference, ["row", "col"]).groupBy("sample_id").agg(
        F.max(F.abs(d)).alias("max_abs"), F.sqrt(F.avg(d * d)).alias("rms"), F.avg(d).alias("mean")
    )


def _neighbours(fields: DataFrame) -> DataFrame:
    down = F.lag("value").over(W.partitionBy("sample_id", "col").orderBy("row"))
    along = F.lag("value").over(W.partitionBy("sample_id", "row").orderBy("col"))
    return fields.withColumns({"up": down, "left": along})


def correlation(a: str, b: str, undefined: float | None, eps: float = 1e-12) -> Column:
    """Pearson of the pairs where both are known; ``undefined`` where one is constant."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    flat = (F.var_pop(x) * F.var_pop(y)) <= eps * eps
    return F.when(~flat, F.corr(x, y)).otherwise(F.lit(undefined))


def field_features(fields: DataFrame, cell_m: float, undefined: float | None = 0.0) -> DataFrame:
    """mean, std, q05, q50, q95, gradient RMS and lag-one correlation by row and by column.

    Each correlation has separate means for its two shifted sides; where one
    side is constant it is ``undefined`` (0 in training profiles, null in
    short-range features).
    """
    dy, dx = (F.col("value") - F.col("up")) / cell_m, (F.col("value") - F.col("left")) / cell_m
    q = F.percentile("value", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = _neighbours(fields).groupBy("sample_id").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), q.alias("q"),
        F.sqrt(F.avg(dy * dy)).alias("gradient_y"), F.sqrt(F.avg(dx * dx)).alias("gradient_x"),
        correlation("value", "up", undefined).alias("lag1_y"), correlation("value", "left", undefined).alias("lag1_x"),
    )
    return out.withColumns({n: F.col("q")[k] for k, n in enumerate(("q05", "q50", "q95"))}).drop("q")


def structural_features(fields: DataFrame, low: float, high: float) -> DataFrame:
    """Population variance, quantiles, gradients and shares of low and high cells."""
    q = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    dy, dx = F.col("value") - F.col("up"), F.col("value") - F.col("left")
    out = _neighbours(fields).groupBy("sample_id").agg(
        F.var_pop("value").alias("variance"), q.alias("q"), F.sqrt(F.avg(dy * dy)).alias("gradient_y"), F.sqrt(F.avg(dx * dx)).alias("gradient_x"),
        F.avg((F.col("value") <= low).cast("double")).alias("low_fraction"), F.avg((F.col("value") >= high).cast("double")).alias("high_fraction"),
    )
    return out.withColumns({n: F.col("q")[k] for k, n in enumerate(("q10", "q50", "q90"))}).drop("q")


def agreement(fields: DataFrame, reference: DataFrame) -> DataFrame:
    """Bias, RMSE, MAE, largest error, clipped correlation, median ratio and share within 10 %, in log10 space."""
    d = F.col("value") - F.col("reference")
    ratio = F.pow(F.lit(10.0), d)
    return fields.join(reference, ["row", "col"]).groupBy("sample_id").agg(
        F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.max(F.abs(d)).alias("max_abs"),
        F.least(F.lit(1.0), F.greatest(F.lit(-1.0), correlation("value", "reference", None))).alias("correlation"),
        F.percentile(ratio, F.lit(0.5)).alias("median_ratio"), F.avg((F.abs(ratio - 1) <= 0.1).cast("double")).alias("within_10_percent"),
    )


def marginal(fields: DataFrame) -> DataFrame:
    """Mean, std and variance of the logarithm, range and five quantiles."""
    q = F.percentile("value", F.array(*(F.lit(x) for x in (0.01, 0.05, 0.5, 0.95, 0.99))))
    out = fields.groupBy("sample_id").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.var_samp("value").alias("variance"), F.min("value").alias("min"), F.max("value").alias("max"), q.alias("q")
    )
    return out.withColumns({n: F.col("q")[k] for k, n in enumerate(("q01", "q05", "q50", "q95", "q99"))}).drop("q")


def plume(fields: DataFrame, background: float, threshold: float) -> DataFrame:
    """Range, population std, gradient RMS, and fraction, centroid and box of the cells whose anomaly reaches the threshold."""
    delta = F.col("value") - background
    hot = F.abs(delta) >= threshold
    dy, dx = F.col("value") - F.col("up"), F.col("value") - F.col("left")
    row, col = F.when(hot, F.col("row")), F.when(hot, F.col("col"))
    return _neighbours(fields).groupBy("sample_id").agg(
        (F.max("value") - F.min("value")).alias("range"), F.avg(delta).alias("mean_anomaly"), F.stddev_pop("value").alias("std"),
        F.sqrt((F.avg(dy * dy) + F.avg(dx * dx)) / 2).alias("gradient_rms"), F.avg(hot.cast("double")).alias("plume_fraction"),
        F.avg(row).alias("centroid_row"), F.avg(col).alias("centroid_col"), F.min(row).alias("row_min"), F.max(row).alias("row_max"),
        F.min(col).alias("col_min"), F.max(col).alias("col_max"),
    )


def flow(fields: DataFrame, other: DataFrame) -> DataFrame:
    """Speed quantiles and component means of vectors (value, other)."""
    speed = F.hypot("value", "other")
    out = fields.join(other, ["sample_id", "row", "col"]).groupBy("sample_id").agg(
        F.percentile(speed, F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99))).alias("q"), F.max(speed).alias("max_speed"), F.avg("value").alias("mean_u"), F.avg("other").alias("mean_v")
    )
    return out.withColumns({n: F.col("q")[k] for k, n in enumerate(("q01", "q50", "q99"))}).drop("q")


def sample_errors(fields: DataFrame, reference: DataFrame) -> DataFrame:
    """log10 RMSE, relative RMSE in percent and absolute RMSE of 10^value against 10^reference."""
    d = F.col("value") - F.col("reference")
    relative, absolute = F.expm1(F.log(F.lit(10.0)) * d), F.pow(F.lit(10.0), "value") - F.pow(F.lit(10.0), "reference")
    rms = lambda x: F.sqrt(F.avg(x * x))
    return fields.join(reference, ["row", "col"]).groupBy("sample_id").agg(
        rms(d).alias("log10_rmse"), (100 * rms(relative)).alias("relative_rmse_percent"), rms(absolute).alias("absolute_rmse")
    )


def outside_range(fields: DataFrame, low: float, high: float) -> DataFrame:
    """Share of cells below low or above high, by sample and, with a null id, over all."""
    out = ((F.col("value") < low) | (F.col("value") > high)).cast("double")
    return fields.rollup("sample_id").agg(F.avg(out).alias("outside_fraction"))


def gradients_central(fields: DataFrame, cell_m: float) -> DataFrame:
    """Central differences within, one-sided ones at the edges, and their magnitude."""

    def along(axis: str, other: str) -> Column:
        w = W.partitionBy("sample_id", other).orderBy(axis)
        before, after = F.lag("value").over(w), F.lead("value").over(w)
        mid = (after - before) / (2 * cell_m)
        return F.coalesce(mid, (after - F.col("value")) / cell_m, (F.col("value") - before) / cell_m, F.lit(0.0))

    out = fields.withColumns({"gy": along("row", "col"), "gx": along("col", "row")})
    return out.withColumn("magnitude", F.hypot("gy", "gx"))


def patch_lattice(spark, height: int, width: int, box: int, step: int) -> DataFrame:
    """Upper left corners of overlapping patches."""
    n = (height - box) * (width - box) // (step * step)
    i = F.col("id")
    at = lambda x: F.floor(x).cast("int")
    return spark.range(n).select(
        i.cast("int").alias("patch"), (at(i * step / (width - box)) * step).alias("row0"), ((i * step) % (width - box)).cast("int").alias("col0")
    )


def patch_features(fields: DataFrame, patches: DataFrame, box: int) -> DataFrame:
    """Mean and std of each patch of each sample; patches are few and are met by range."""
    r, c = F.col("row"), F.col("col")
    inside = (r >= F.col("row0")) & (r < F.col("row0") + box) & (c >= F.col("col0")) & (c < F.col("col0") + box)
    return fields.join(patches, inside).groupBy("sample_id", "patch").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def relative_l2(difference: Column, reference: Column) -> Column:
    """sqrt of sums of squares; 0 by 0 is 0, x by 0 is infinite."""
    return safe_divide(F.sqrt(F.sum(difference * difference)), F.sqrt(F.sum(reference * reference)))
