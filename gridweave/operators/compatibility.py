"""Fields against a target distribution, and generated fields against training fields; nothing is filtered by the outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridweave.operators.ranks import distance, quantile, running
from gridweave.operators.spatial import directional_variograms

LEVELS = {"q01": 0.01, "q05": 0.05, "q50": 0.5, "q95": 0.95, "q99": 0.99}
DIRECTIONS = {"y": (1, 0), "x": (0, 1), "diagonal": (1, 1)}


def marginal_report(fields: DataFrame, mean: float, std: float, low: float, high: float, least_inside: float) -> DataFrame:
    """The pooled values, and each field's, against a normal target of their logarithms.

    scope (pooled, field), sample_id (null for pooled), n, mean, std, their
    errors, shares below low, inside and above high, quantiles, and whether
    enough lies inside. Moments, shares and quantiles are exact and count every
    value; null and NaN values don't count, and a field without others, like an
    empty table, gives no row. One value has std 0.
    """
    known = fields.where(F.col("value").isNotNull() & ~F.isnan("value"))
    share = lambda c: F.avg(c.cast("double"))
    value = F.col("value")
    shares = [share(value < low).alias("below"), share((value >= low) & (value <= high)).alias("inside"), share(value > high).alias("above")]
    moments = [F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), *shares]
    each = known.groupBy("sample_id").agg(*moments, F.percentile("value", F.array(*map(F.lit, LEVELS.values()))).alias("q"))
    each = each.select(F.lit("field").alias("scope"), "sample_id", *(c for c in each.columns if c not in ("sample_id", "q")), *(F.col("q")[k].alias(n) for k, n in enumerate(LEVELS)))
    levels = running(known.select("value", F.lit(1).alias("n")), ["n"]).agg(*(quantile(p).alias(n) for n, p in LEVELS.items()))
    pooled = known.agg(*moments).where("n > 0").join(F.broadcast(levels))  # one row each
    pooled = pooled.withColumns({"scope": F.lit("pooled"), "sample_id": F.lit(None).cast("long")})
    out = pooled.unionByName(each)
    return out.withColumns({"mean_error": F.col("mean") - mean, "std_error": F.col("std") - std, "status": F.when(F.col("inside") >= least_inside, "pass").otherwise("warn")})


def ensemble_fidelity(fields: DataFrame, generated: Column, lags: list[int]) -> DataFrame:
    """part, statistic, value: distances of generated fields from the others.

    marginal: W1, differences of mean and std and absolute ones of quantiles,
    over all values. Each direction: root mean square error of the generated
    variogram over the lags, the same relative to the other variogram's size,
    and the correlation of both curves (null for one lag or a constant curve).
    With only one of both kinds all are null.
    """
    kind = fields.select("sample_id", "row", "col", "value", generated.alias("generated"))
    value = lambda own: F.when(F.col("generated") == own, F.col("value"))
    moments = kind.agg((F.avg(value(True)) - F.avg(value(False))).alias("mean_error"), (F.stddev_samp(value(True)) - F.stddev_samp(value(False))).alias("std_error"))
    counted = running(kind.select("value", F.col("generated").cast("int").alias("g"), (~F.col("generated")).cast("int").alias("t")), ["g", "t"])
    ranks = counted.agg(distance("g", "t").alias("w1"), *(F.abs(quantile(p, "g") - quantile(p, "t")).alias(f"{n}_error") for n, p in LEVELS.items()))
    marginal = ranks.join(F.broadcast(moments))  # one row each
    names = marginal.columns
    marginal = marginal.select(F.lit("marginal").alias("part"), *names).unpivot(["part"], names, "statistic", "value")

    curve = directional_variograms(kind, DIRECTIONS, lags, ("generated",))
    of = lambda own: F.max(F.when(F.col("generated") == own, F.col("gamma")))
    pairs = curve.groupBy("direction", "lag").agg(of(True).alias("g"), of(False).alias("t"))
    error = F.sqrt(F.avg((F.col("g") - F.col("t")) * (F.col("g") - F.col("t"))))
    scale = F.greatest(F.sqrt(F.avg(F.col("t") * F.col("t"))), F.lit(2.0**-52))
    varies = (F.stddev_pop("g") > 0) & (F.stddev_pop("t") > 0)
    shapes = pairs.groupBy(F.col("direction").alias("part")).agg(error.alias("rmse"), (error / scale).alias("relative_rmse"), F.when(varies, F.corr("g", "t")).alias("curve_correlation"))
    return marginal.unionByName(shapes.unpivot(["part"], ["rmse", "relative_rmse", "curve_correlation"], "statistic", "value"))


def training_compatibility(features: DataFrame, generated: Column, names: list[str]) -> DataFrame:
    """Each descriptor of generated fields beside that of training fields.

    metric, then for both n, mean, std (0 for one), min and max; the z-score of
    the generated mean (null where the training std is 0) and the share of
    generated fields outside the training range. Null descriptors don't count.
    """
    long = features.select(generated.alias("generated"), *names).unpivot(["generated"], names, "metric", "x").where("x is not null")
    stats = lambda p: [F.count("*").alias(f"{p}_n"), F.avg("x").alias(f"{p}_mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias(f"{p}_std"), F.min("x").alias(f"{p}_min"), F.max("x").alias(f"{p}_max")]
    reference = long.where(~F.col("generated")).groupBy("metric").agg(*stats("training"))  # a row a descriptor
    outside = ((F.col("x") < F.col("training_min")) | (F.col("x") > F.col("training_max"))).cast("double")
    found = long.where("generated").join(F.broadcast(reference), "metric").groupBy(*reference.columns).agg(*stats("generated"), F.avg(outside).alias("outside"))
    z = (F.col("generated_mean") - F.col("training_mean")) / F.col("training_std")
    return found.withColumn("z_score", F.when(F.col("training_std") > 2.0**-52, z))
