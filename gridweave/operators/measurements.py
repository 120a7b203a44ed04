"""Measurement ingest: quality control, grids, surfaces and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridweave.operators.summaries import quantiles


def with_reason(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """df with reason, the first rule that a row fails, null for good rows."""
    reason = F.lit(None).cast("string")
    for name, failed in reversed(rules):
        reason = F.when(failed, name).otherwise(reason)
    return df.withColumn("reason", reason)


def grid_footprint(xyz: DataFrame) -> DataFrame:
    """One row: distinct XY cells, origin, median spacing and the grid's shape."""
    xy = xyz.select("x", "y").distinct()

    def spacing(c: str) -> DataFrame:
        own = xy.select(c).distinct().withColumn("d", F.col(c) - F.lag(c).over(W.orderBy(c)))
        return own.agg(F.percentile("d", F.lit(0.5)).alias(f"d{c}"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))

    out = xy.agg(F.count("*").alias("active")).join(spacing("x")).join(spacing("y"))
    size = lambda c: (F.rint((F.col(f"{c}_max") - F.col(f"{c}_min")) / F.col(f"d{c}")) + 1).cast("int")
    return out.select("active", "x_min", "y_min", "dx", "dy", size("x").alias("nx"), size("y").alias("ny"))


def surface(xyz: DataFrame, column: str, mode: str, z: float | None = None) -> DataFrame:
    """x, y, value of a column collapsed over z; values that are not finite and positive are skipped, the first wins at ties."""
    value = F.col(column)
    good = xyz.where((value > 0) & (value < float("inf")))
    agg = {
        "top": F.max_by(value, F.col("z")), "bottom": F.min_by(value, F.col("z")), "first": F.min_by(value, F.col("z")),
        "nearest": F.min_by(value, F.struct(F.abs(F.col("z") - (z or 0)), F.col("z"))), "log_geomean": F.pow(F.lit(10.0), F.avg(F.log10(value))),
    }[mode]
    return good.groupBy("x", "y").agg(agg.alias("value"))


def surface_sweep(xyz: DataFrame, columns: list[str]) -> DataFrame:
    """x, y, column, mode, value of every column by top, bottom and log_geomean in one pass."""
    parts, names = [], []
    for c in columns:
        v = F.when((F.col(c) > 0) & (F.col(c) < float("inf")), F.col(c))
        z = F.when(v.isNotNull(), F.col("z"))
        for mode, a in (("top", F.max_by(v, z)), ("bottom", F.min_by(v, z)), ("log_geomean", F.pow(F.lit(10.0), F.avg(F.log10(v))))):
            parts.append(a.alias(f"{c}:{mode}"))
            names.append(f"{c}:{mode}")
    wide = xyz.groupBy("x", "y").agg(*parts)
    long = wide.unpivot(["x", "y"], [f"`{n}`" for n in names], "name", "value")
    split = F.split("name", ":")
    return long.select("x", "y", split[0].alias("column"), split[1].alias("mode"), "value")


def cell_means(points: DataFrame, size: float) -> DataFrame:
    """Per occupied cell: count, mean log10, geometric mean and variance (0 for one)."""
    cell = [F.floor(F.col(c) / size).cast("int").alias(n) for c, n in (("y_m", "iy"), ("x_m", "ix"))]
    return points.groupBy(*cell).agg(
        F.count("*").alias("count"), F.avg("log10_k").alias("mean_log10"), F.pow(F.lit(10.0), F.avg("log10_k")).alias("geometric_mean"), F.coalesce(F.var_samp("log10_k"), F.lit(0.0)).alias("variance")
    )


def measurement_summary(points: DataFrame, size: float) -> DataFrame:
    q = quantiles("k", (0.05, 0.5, 0.95))
    cell = F.struct(F.floor(F.col("x_m") / size), F.floor(F.col("y_m") / size))
    out = points.agg(
        F.count("*").alias("n"), F.min("k").alias("min"), F.avg("k").alias("mean"), F.max("k").alias("max"), q.alias("q"), F.avg("log10_k").alias("mean_log10"),
        F.stddev_samp("log10_k").alias("std_log10"), F.count_distinct(cell).alias("cells"),
    )
    return out.withColumns({n: F.col("q")[k] for k, n in enumerate(("q05", "median", "q95"))}).drop("q")


def colocated(points: DataFrame) -> DataFrame:
    return points.groupBy("x_m", "y_m").agg(F.count("*").alias("count")).where("count > 1")


def robust_change(base: DataFrame, robust: DataFrame) -> DataFrame:
    """model, score, robust score and percent change."""
    both = base.join(robust.withColumnRenamed("score", "robust"), "model")
    return both.select("model", "score", "robust", (100 * (F.col("robust") - F.col("score")) / F.col("score")).alias("percent_change"))


def fallback(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """key, value of first where it has one, else of second."""
    both = first.withColumnRenamed("value", "_a").join(second.withColumnRenamed("value", "_b"), key, "full")
    return both.select(key, F.coalesce("_a", "_b").alias("value"))


def channels_denormalized(tensor: DataFrame, stats: DataFrame) -> DataFrame:
    """Values in [0, 1] back to each channel's range (channel, low, high)."""
    return tensor.join(F.broadcast(stats), "channel").withColumn("value", F.col("value") * (F.col("high") - F.col("low")) + F.col("low"))
