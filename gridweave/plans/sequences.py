"""Queries of record sequences, streaming snapshots and repeated designs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.operators import designs as D
from gridweave.plans.registry import query
from gridweave.randomfield.continuous import ContinuousExpansion
from gridweave.sources import records as R
from gridweave.sources.places import own_place
from gridweave.sources.views import BACKGROUND, BUDGETS, WIDTH
from gridweave.streaming.snapshots import kept, snapshots


@query(
    "resumable_records",
    f"""-- doubles: total
    select concat('case-', vec_id % 8) as "case", count(*) as records, min(vec_id // 8) as first, max(vec_id // 8) as last, sum({BACKGROUND}::double + 4 * list_sum(list_transform(embedding, lambda x: x::double)) / 64) as total
    from embeddings group by vec_id % 8""",
)
def resumable_records(v):
    """Predictions of every sample as a record, of which the first quarter is written by a run that ends early and the others by one that verifies it."""
    mean = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")) / 64
    inputs = v.table("embeddings").select(F.concat(F.lit("case-"), (F.col("vec_id") % 8).cast("string")).alias("case"), F.expr("vec_id div 8").alias("sample_index"), "embedding")
    compute = lambda df: df.select("case", "sample_index", (BACKGROUND + 4 * mean).alias("value"))
    portion = (inputs.agg(F.max("sample_index")).first()[0] or 0) // 4 + 1
    path = own_place(v.spark, "records")
    R.continued(inputs, path, compute, portion, most=1)
    found = R.continued(inputs, path, compute, portion)
    R.verified(found)
    return found.groupBy("case").agg(F.count("*").alias("records"), F.min("sample_index").alias("first"), F.max("sample_index").alias("last"), F.sum("value").alias("total"))


@query(
    "streaming_checkpoints",
    "-- doubles: mean variance std min max\nselect row, col, count(*) as count, avg(value) as mean, var_samp(value) as variance, stddev_samp(value) as std, min(value) as min, max(value) as max from fields_long, budgets where sample_id < budget group by budget, row, col having count(*) = budget",
    "fields_long budgets",
)
def streaming_checkpoints(v):
    """Moments of each cell, kept as the samples arrive as a stream, at the budgets."""
    source = f"{v.sf_dir}/embeddings.parque[t]"  # a stream takes a folder or a pattern, and a table may be one file
    stream = v.spark.readStream.schema(v.table("embeddings").schema).option("maxFilesPerTrigger", 64).parquet(source)
    flat = stream.select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("pos", "v"))
    fields = flat.select("sample_id", F.expr(f"int(pos div {WIDTH})").alias("row"), (F.col("pos") % WIDTH).cast("int").alias("col"), F.col("v").cast("double").alias("value"))
    path = own_place(v.spark, "snapshots")
    kept(snapshots(fields, list(BUDGETS)), f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return v.spark.read.schema("row int, col int, count long, mean double, variance double, std double, min double, max double").parquet(f"{path}/table")


@query("rq1_repeated")
def rq1_repeated(v):
    """Sixteen repetitions of two methods for each label's fields: errors by budget against the pooled reference, and what the quasi-random one gains."""
    logs = v.table("embeddings").select("label", F.explode("embedding").alias("v")).groupBy(F.col("label").alias("variant"))
    variants = logs.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sigma"))  # in units of 10^-9.3
    expansion = ContinuousExpansion.fit(8, 8, 1.0, 0.0, 1.0, 4.0, share=0.8)
    return D.repeated_errors(D.repeated_prefixes(D.repeated(variants, expansion, 16, 64, 11), [8, 16, 32, 64]))
