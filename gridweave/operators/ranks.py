"""Exact distribution functions, quantiles and distances of pooled values, without a task that holds them all.

Values are counted first. Distinct values are dealt into stretches at
approximate quantiles, so an outlier or a heavy value doesn't decide how wide
they are; running counts are windows within a stretch, on top of the sums of
the stretches before. Null and NaN values take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Stretches that distinct values are dealt into.
STRETCHES = 128


def running(values: DataFrame, counts: list[str], stretches: int = STRETCHES, by: tuple[str, ...] = ()) -> DataFrame:
    """Each distinct ``value`` of a key with the sums of ``counts``, ``upto_c`` and ``total_c`` of each, and the ``next`` greater value (null for the last).

    Stretches are those of all keys' values, so one key with most rows is many windows too.
    """
    known = values.where(F.col("value").isNotNull() & ~F.isnan("value")).select(*by, F.col("value").cast("double").alias("value"), *counts)
    shares = [k / stretches for k in range(1, stretches)]
    edges = sorted(set(known.agg(F.percentile_approx("value", shares, 1000)).first()[0] or [])) if shares else []
    dealt = F.size(F.filter(F.lit(edges).cast("array<double>"), lambda e: e < F.col("value")))
    own = known.groupBy(*by, "value").agg(*(F.sum(c).alias(c) for c in counts)).withColumn("stretch", dealt)
    # The cast keeps the optimizer from inferring a filter on value for the sums, which have none.
    sums = own.groupBy(*by, F.col("stretch").cast("long").alias("stretch")).agg(F.min("value").alias("first"), *(F.sum(c).alias(f"in_{c}") for c in counts))
    order, everything = W.partitionBy(*by).orderBy("stretch"), W.partitionBy(*by)  # a row a stretch
    sums = sums.select(
        *by, "stretch", F.lead("first").over(order).alias("follows"),
        *(F.sum(f"in_{c}").over(everything).alias(f"total_{c}") for c in counts), *((F.sum(f"in_{c}").over(order) - F.col(f"in_{c}")).alias(f"before_{c}") for c in counts),
    )
    within = W.partitionBy(*by, "stretch").orderBy("value")
    placed = own.withColumns({"next": F.lead("value").over(within), **{f"upto_{c}": F.sum(c).over(within) for c in counts}})
    placed = placed.withColumn("stretch", F.col("stretch").cast("long")).join(sums if by else F.broadcast(sums), [*by, "stretch"])  # without keys, a row a stretch
    return placed.select(*by, "value", F.coalesce("next", "follows").alias("next"), *counts, *((F.col(f"before_{c}") + F.col(f"upto_{c}")).alias(f"upto_{c}") for c in counts), *(f"total_{c}" for c in counts))


def ranked(rank: int | None, count: str = "n") -> Column:
    """Over rows of ``running``: the value of a 1-based rank; null for none."""
    if rank is None:
        return F.lit(None).cast("double")
    return F.max(F.when((F.col(f"upto_{count}") >= rank) & (F.col(f"upto_{count}") - F.col(count) < rank), F.col("value")))


def quantile(p: float, count: str = "n") -> Column:
    """Over rows of ``running``: the exact quantile, between neighbouring values in proportion."""
    place = F.lit(float(p)) * (F.col(f"total_{count}") - 1)
    holds = lambda k: F.max(F.when((F.col(f"upto_{count}") > k) & (F.col(f"upto_{count}") - F.col(count) <= k), F.col("value")))
    low, high, share = holds(F.floor(place)), holds(F.ceil(place)), F.max(place - F.floor(place))
    return low + (high - low) * share


def distance(x: str, y: str) -> Column:
    """Over rows of ``running``: W1 of the samples that two counts make, the integral of the distance of their distribution functions; null if one is empty."""
    gap = F.abs(F.col(f"upto_{x}") / F.nullif(F.col(f"total_{x}"), F.lit(0)) - F.col(f"upto_{y}") / F.nullif(F.col(f"total_{y}"), F.lit(0)))
    return F.when(F.max(gap).isNotNull(), F.coalesce(F.sum(gap * (F.col("next") - F.col("value"))), F.lit(0.0)))
