"""Per-cell statistics of an ensemble that arrives as a stream of samples.

Samples are read as they come; each micro-batch becomes one row a cell of
count, mean and squared deviations, keyed by the batch, and merging these
rows gives the same numbers as one pass over all samples, however they were
cut into batches. A batch that is run again after a failure replaces its own
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def partials(fields: DataFrame) -> DataFrame:
    """row, col, n, m, s, low, high of a batch."""
    return fields.groupBy("row", "col").agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count("value")).alias("s"), F.min("value").alias("low"), F.max("value").alias("high")
    )


def merged(parts: DataFrame) -> DataFrame:
    """count, mean, variance, std, min, max from partial rows: deviations about own means plus those of the means.

    The means' deviations are sums too, about a first mean, so no list of
    batches is gathered for a cell.
    """
    n, m = F.col("n"), F.col("m")
    middle = parts.groupBy("row", "col").agg((F.sum(n * m) / F.sum(n)).alias("mean"))
    d = m - F.col("mean")
    out = parts.join(middle, ["row", "col"]).groupBy("row", "col", "mean").agg(
        F.sum(n).alias("count"), F.sum("s").alias("within"), F.sum(n * d * d).alias("between"), F.min("low").alias("min"), F.max("high").alias("max")
    )
    out = out.withColumn("variance", F.when(F.col("count") > 1, (F.col("within") + F.col("between")) / (F.col("count") - 1)))
    return out.select("row", "col", "count", "mean", "variance", F.sqrt("variance").alias("std"), "min", "max")


def accumulate(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the partial rows of each micro-batch of a stream of sample_id, row, col, value to a folder of its own."""

    def write(batch: DataFrame, number: int) -> None:
        partials(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark: SparkSession, path: str) -> DataFrame:
    return merged(spark.read.parquet(path))
