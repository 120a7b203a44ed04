"""Results that are written once and verified when a study is resumed."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, functions as F


def seed_for(*labels) -> int:
    """A seed of 64 bits from labels: the first eight bytes, little-endian, of the SHA-256 of their canonical JSON list."""
    text = json.dumps(list(labels), sort_keys=True, separators=(",", ":"))
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")


def content(df: DataFrame) -> dict:
    """Row count and an order-free hash of all rows."""
    each = F.xxhash64(*(F.col(f"`{c}`") for c in sorted(df.columns))).cast("decimal(38,0)")
    r = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(each), F.lit(0)).cast("string").alias("hash")).first()
    return {"rows": r["rows"], "hash": r["hash"]}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def written_once(df: DataFrame, path: str) -> DataFrame:
    """The table at a path: written if it isn't complete there, else verified against its ledger and reused.

    Spark's commit leaves _SUCCESS last, so half a table counts as none. A
    complete table whose rows differ from what its ledger says raises.
    """
    spark = df.sparkSession
    data, ledger = f"{path}/data", f"{path}/ledger"
    if _exists(spark, f"{data}/_SUCCESS") and _exists(spark, f"{ledger}/_SUCCESS"):
        found = spark.read.parquet(data)
        if content(found) != json.loads(spark.read.text(ledger).first()[0]):
            raise ValueError(f"{path} is not what was written there")
        return found
    df.write.mode("overwrite").parquet(data)
    found = spark.read.parquet(data)
    spark.createDataFrame([(json.dumps(content(found)),)], "value string").coalesce(1).write.mode("overwrite").text(ledger)
    return found
