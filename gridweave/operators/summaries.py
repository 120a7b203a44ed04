"""Scalar summaries, risk, prefix convergence and comparisons of methods."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridweave.functions.scalars import safe_divide


def quantiles(value: Column | str, probabilities: tuple[float, ...]) -> Column:
    return F.percentile(value, F.array(*(F.lit(p) for p in probabilities)))


def scalar_summary(df: DataFrame, value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """count, mean, sd (0 for one value), q05, q50, q95."""
    out = df.groupBy(*by).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), quantiles(value, (0.05, 0.5, 0.95)).alias("q")
    )
    return out.withColumns({n: F.col("q")[k] for k, n in enumerate(("q05", "q50", "q95"))}).drop("q")


def global_uncertainty(std: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Of a map of standard deviations (column std): u_rms, u95, mean_std, max_std."""
    s = F.col("std")
    return std.groupBy(*by).agg(
        F.sqrt(F.avg(s * s)).alias("u_rms"), F.percentile(s, F.lit(0.95)).alias("u95"), F.avg(s).alias("mean_std"), F.max(s).alias("max_std")
    )


def receptor_risk(df: DataFrame, background: float, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Exceedances, their probability, expected excess, and excess where there is one (null if never)."""
    delta = F.col("value") - background
    hit, over = delta > threshold, F.greatest(delta - threshold, F.lit(0.0))
    return df.groupBy(*by).agg(
        F.count_if(hit).alias("exceed_count"), F.avg(hit.cast("double")).alias("probability"), F.avg(over).alias("expected_excess"), F.avg(F.when(hit, over)).alias("conditional_excess")
    )


def tail_risk(df: DataFrame, probability: float, by: tuple[str, ...] = ()) -> DataFrame:
    """VaR, the inverse-CDF quantile, and expected shortfall with its atom shared."""
    var = df.groupBy(*by).agg(F.expr(f"percentile_disc({probability}) within group (order by value)").alias("value_at_risk"))
    met = df.join(var, list(by)) if by else df.join(F.broadcast(var))
    over = F.greatest(F.col("value") - F.col("value_at_risk"), F.lit(0.0))
    return met.groupBy(*by, "value_at_risk").agg((F.first("value_at_risk") + F.avg(over) / (1 - probability)).alias("expected_shortfall"))


def binomial_ranks(n: int, p: float, confidence: float) -> tuple[int | None, int | None]:
    """1-based ranks of the order statistics that enclose a quantile; None is an infinite end."""
    tail, cdf, low, high = (1 - confidence) / 2, 0.0, None, None
    for k in range(n + 1):
        cdf += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
        if low is None and cdf >= tail:
            low = k
        if high is None and cdf >= 1 - tail:
            high = k + 1
            break
    return (low if low and low >= 1 else None), (high if high and high <= n else None)


def quantile_interval(df: DataFrame, probability: float, confidence: float) -> DataFrame:
    """lower, upper: the distribution-free interval of a quantile, from ranks; null values don't count."""
    df = df.where("value is not null")
    low, high = binomial_ranks(df.count(), probability, confidence)
    at = lambda k: order_statistic(df, k) if k else F.lit(None).cast("double")
    return df.sparkSession.range(1).select(at(low).alias("lower"), at(high).alias("upper"))


def order_statistic(df: DataFrame, rank: int) -> Column:
    """The value of a 1-based rank, as a literal.

    Approximate quantiles give a narrow band about the rank; the rows below
    it are counted and only those inside are sorted.
    """
    n = df.count()
    p = rank / n
    shares = [max(0.0, p - 2e-3), min(1.0, p + 2e-3)]
    low, high = df.agg(F.percentile_approx("value", shares, 10_000)).first()[0]
    below = df.where(F.col("value") < low).count() if shares[0] > 0 else 0
    band = df.where((F.col("value") >= low) & (F.col("value") <= high)) if shares[0] > 0 else df.where(F.col("value") <= high)
    kept = band.groupBy("value").agg(F.count("*").alias("n")).orderBy("value")
    upto = kept.select("value", (F.lit(below) + F.sum("n").over(W.orderBy("value"))).alias("upto"))
    found = upto.where(F.col("upto") >= rank).orderBy("value").first()
    return F.lit(found["value"])


def stopping_table(cases: DataFrame, limits: DataFrame) -> DataFrame:
    """limit and the first n whose estimate, and whose upper end, is no larger; null if none is."""
    met = limits.join(cases, F.col("estimate") <= F.col("limit"), "left")
    first = met.groupBy("limit").agg(F.min("n").alias("first_estimate"), F.min(F.when(F.col("upper") <= F.col("limit"), F.col("n"))).alias("first_upper"))
    return first


def mean_sem(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """mean, sd and standard error; both null for one value."""
    return df.groupBy(*by).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("sem")
    )


def method_gain(errors: DataFrame, by: tuple[str, ...] = ("budget", "target"), first: str = "MC", second: str = "RQMC") -> DataFrame:
    """RMSE of two methods and their ratio, where both occur; infinite if the second has none."""
    e2 = F.col("error") * F.col("error")
    own = lambda m: F.col("method") == m
    out = errors.groupBy(*by).agg(
        F.sqrt(F.avg(F.when(own(first), e2))).alias("rmse_first"), F.sqrt(F.avg(F.when(own(second), e2))).alias("rmse_second"),
        F.least(F.count_if(own(first)), F.count_if(own(second))).alias("repetitions"),
    )
    return out.where("repetitions > 0").withColumn("gain", safe_divide(F.col("rmse_first"), F.col("rmse_second")))


def prefix_fields(fields: DataFrame, budgets: DataFrame) -> DataFrame:
    """Each sample in every budget that it belongs to."""
    return fields.join(F.broadcast(budgets), F.col("sample_id") < F.col("budget"))


def prefix_field_convergence(fields: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each budget the RMS distance of mean and std to those of all samples, and the uncertainty of its map.

    One pass: running sums are taken by (sample's budget, cell), which are
    few, and added up over the budgets; samples aren't copied.
    """
    steps = [r["budget"] for r in budgets.orderBy("budget").collect()]
    step = F.lit(None).cast("int")
    for b in reversed(steps):
        step = F.when(F.col("sample_id") < b, b).otherwise(step)
    own = fields.withColumn("step", F.coalesce(step, F.lit(2**31 - 1))).groupBy("step", "row", "col").agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), F.coalesce(F.var_pop("value") * F.count("value"), F.lit(0.0)).alias("s")
    )
    w = W.partitionBy("row", "col").orderBy("step")
    n, total = F.sum("n").over(w), F.sum(F.col("n") * F.col("m")).over(w)
    run = own.select("step", "row", "col", "n", "m", "s", n.alias("n_run"), (total / n).alias("m_run"))
    # Sum of squares about the running mean, from those about each step's own.
    both = run.alias("a").join(run.alias("b"), F.expr("a.row = b.row and a.col = b.col and b.step <= a.step"))
    shifted = F.expr("sum(b.s + b.n * (b.m - a.m_run) * (b.m - a.m_run))")
    stats = both.groupBy(F.expr("a.step").alias("budget"), F.expr("a.row").alias("row"), F.expr("a.col").alias("col")).agg(
        F.expr("any_value(a.m_run)").alias("mean"), F.sqrt(shifted / (F.expr("any_value(a.n_run)") - 1)).alias("std")
    )
    last = W.partitionBy("row", "col")
    stats = stats.withColumns({"ref_mean": F.max_by("mean", "budget").over(last), "ref_std": F.max_by("std", "budget").over(last)})
    gap = lambda a, b: F.sqrt(F.avg((F.col(a) - F.col(b)) * (F.col(a) - F.col(b))))
    out = stats.where(F.col("budget").isin(steps)).groupBy("budget").agg(
        gap("mean", "ref_mean").alias("e_mu"), gap("std", "ref_std").alias("e_sigma"), F.sqrt(F.avg(F.col("std") * F.col("std"))).alias("u_rms"),
        F.percentile(F.col("std").cast("float").cast("double"), F.lit(0.95)).alias("u95"), F.avg("std").alias("mean_std"), F.max("std").alias("max_std"),
    )
    return out


def scalar_prefix_convergence(values: DataFrame, budgets: DataFrame) -> DataFrame:
    """budget, statistic, estimate, reference, error, abs_error of sample_id, value."""
    stats = ("mean", "sd", "q05", "q50", "q95")
    long = lambda df, by, name: df.unpivot(by, list(stats), "statistic", name)
    own = long(scalar_summary(prefix_fields(values, budgets), by=("budget",)), ["budget"], "estimate")
    every = long(scalar_summary(values), [], "reference")
    error = F.col("estimate") - F.col("reference")
    return own.join(every, "statistic").select("budget", "statistic", "estimate", "reference", error.alias("error"), F.abs(error).alias("abs_error"))


def paired_contrast(cases: DataFrame, reference: str) -> DataFrame:
    """Paired differences of each profile to the reference profile over trials: mean and standard error."""
    ref = cases.where(F.col("profile") == reference).select("budget", "trial", F.col("value").alias("base"))
    both = cases.where(F.col("profile") != reference).join(ref, ["budget", "trial"])
    return mean_sem(both.withColumn("value", F.col("value") - F.col("base")), ("budget", "profile"))


def reduction_from_prior(cases: DataFrame) -> DataFrame:
    """Each case with n > 0 against the same budget's n = 0: difference and fraction remaining (null if the prior is 0)."""
    prior = cases.where("n = 0").select("budget", F.col("value").alias("prior"))
    x = cases.where("n > 0").join(prior, "budget")
    return x.select("budget", "n", "value", (F.col("prior") - F.col("value")).alias("reduction"), F.when(F.col("prior") != 0, F.col("value") / F.col("prior")).alias("remaining"))
