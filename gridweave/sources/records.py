"""Sequences of records that are verified before they are continued.

Each case has records 0, 1, 2, ..., whose index is their position. Records are
committed in portions; a portion counts once its table is complete, so a job
that is killed loses what it hadn't committed and nothing else. Whoever
continues a sequence checks all that is there: an index that is missing or
repeated, a record that no longer has the hash it was written with, and an
input that is not the one a record was made from are errors, not gaps to be
filled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

KEYS = ("case", "sample_index")


def _hash(columns) -> "F.Column":
    """SHA-256 of columns in the order of their names, as JSON, which tells null from empty."""
    return F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(columns))), {"ignoreNullFields": "false"}), 256)


def _portions(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """The numbers of all portions, and whether each is complete."""
    home = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(home):
        return []
    found = [s.getPath() for s in files.listStatus(home) if s.getPath().getName().startswith("portion=")]
    done = lambda p: files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted((int(p.getName().split("=")[1]), done(p)) for p in found)


def committed(spark: SparkSession, path: str) -> DataFrame | None:
    """All records of complete portions; None before the first."""
    numbers = [n for n, complete in _portions(spark, path) if complete]
    return spark.read.parquet(*(f"{path}/portion={n}" for n in numbers)) if numbers else None


def verified(records: DataFrame) -> DataFrame:
    """case, done (the next index) of records whose indices are positions and whose hashes hold; others raise."""
    content = [c for c in records.columns if c != "record_hash"]
    each = records.withColumn("_changed", _hash(content) != F.col("record_hash")).groupBy(*KEYS).agg(F.count("*").alias("n"), F.bool_or("_changed").alias("changed"))
    cases = each.groupBy("case").agg(F.count("*").alias("done"), F.min("sample_index").alias("low"), F.max("sample_index").alias("high"), F.max("n").alias("most"), F.bool_or("changed").alias("changed"))
    bad = cases.where("changed or most > 1 or low <> 0 or high <> done - 1").limit(3).collect()
    if bad:
        raise ValueError("; ".join(f"case {r['case']}: " + ("a record has changed" if r["changed"] else "an index is missing or repeated") for r in bad))
    return cases.select("case", "done")


def _commit(records: DataFrame, path: str) -> None:
    spark = records.sparkSession
    number = max([n for n, complete in _portions(spark, path) if complete], default=-1) + 1
    content = records.columns
    records.withColumn("record_hash", _hash(content)).write.mode("overwrite").parquet(f"{path}/portion={number}")


def _open(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """What of wanted (case, sample_index, input_hash, ...) is to be done: all after the verified records, whose inputs must be the same."""
    there = committed(spark, path)
    if there is None:
        return wanted
    done = verified(there)
    known = there.select(*KEYS, F.col("input_hash").alias("_known"))
    other = wanted.join(known, list(KEYS)).where("input_hash <> _known").limit(1).collect()
    if other:
        raise ValueError(f"record {other[0]['sample_index']} of case {other[0]['case']} was made from another input")
    return wanted.join(done, "case", "left").where(F.col("sample_index") >= F.coalesce("done", F.lit(0))).drop("done")


def continued(inputs: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], portion: int = 256, most: int | None = None) -> DataFrame:
    """Records of all inputs (case, sample_index, ...): those that are there are verified, the others computed and committed.

    compute gets the rows that are to be done and returns case, sample_index
    and what the records hold. A portion has so many indices of every case;
    ``most`` ends after so many portions. The same call goes on where the last
    ended, whatever ended it. An input without a record before it, and null or
    repeated indices, raise.
    """
    spark = inputs.sparkSession
    wanted = inputs.withColumn("input_hash", _hash(inputs.columns))
    shape = wanted.groupBy(*KEYS).agg(F.count("*").alias("n")).groupBy("case").agg(F.count("sample_index").alias("c"), F.min("sample_index").alias("low"), F.max("sample_index").alias("high"), F.max("n").alias("most"))
    if shape.where("case is null or most > 1 or c = 0 or low <> 0 or high <> c - 1").limit(1).count():
        raise ValueError("inputs have to be numbered 0, 1, 2, ... in every case")
    made = 0
    open_ = _open(spark, path, wanted)
    while most is None or made < most:
        low = open_.agg(F.min(F.floor(F.col("sample_index") / portion))).first()[0]
        if low is None:
            break
        # Cases can stand at different places after a change of the portion's size.
        now = open_.where(F.col("sample_index") < (low + 1) * portion)
        _commit(compute(now.drop("input_hash")).join(now.select(*KEYS, "input_hash"), list(KEYS)), path)
        made, open_ = made + 1, open_.where(F.col("sample_index") >= (low + 1) * portion)
    there = committed(spark, path)
    return there if there is not None else spark.createDataFrame([], "case string, sample_index long, input_hash string, record_hash string")


def accepted(batch: DataFrame, path: str) -> None:
    """Appends a batch of records (case, sample_index, input_hash, ...) that go on where the sequence ends.

    Records that are there with the same input are a replay and are left out;
    a gap, a repeated index or another input raises and nothing is written.
    """
    new = _open(batch.sparkSession, path, batch)
    there = committed(batch.sparkSession, path)
    start = verified(there) if there is not None else batch.sparkSession.createDataFrame([], "case string, done long")
    shape = new.groupBy("case").agg(F.count("*").alias("n"), F.count_distinct("sample_index").alias("c"), F.min("sample_index").alias("low"), F.max("sample_index").alias("high"))
    shape = shape.join(start.withColumn("case", F.col("case").cast(dict(batch.dtypes)["case"])), "case", "left").withColumn("from", F.coalesce("done", F.lit(0)))
    bad = shape.where("case is null or n <> c or low <> from or high <> from + n - 1").limit(1).collect()
    if bad:
        raise ValueError(f"case {bad[0]['case']} goes on at {bad[0]['from']}, not at {bad[0]['low']} to {bad[0]['high']}")
    if not new.isEmpty():
        _commit(new, path)


def record_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of a stream of records is accepted as a whole or fails; a repeated one adds nothing."""
    return stream.writeStream.foreachBatch(lambda batch, _: accepted(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
