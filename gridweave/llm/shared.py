"""Places and small helpers that several operators use."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and all runs on this machine (tests in
    local mode) is a temporary folder of it used and set; a cluster has to
    name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gridweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written once as a Parquet table in the shared folder and read back.

    It cuts the lineage: a lost executor costs no recomputation of what is
    saved, and several readers don't compute it again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a table made by ``saved``: its folder stands in the shared one and holds nothing else."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    home = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = home.getFileSystem(conf)
    home = files.makeQualified(home)
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = files.makeQualified(jvm.org.apache.hadoop.fs.Path(folder))
        if path.getParent().equals(home):
            files.delete(path, True)


_held: dict = {}


def held(key, make):
    """What a Python worker keeps from one task to the next, of one kind of work at a time: another key drops it."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Drops what a Python worker keeps, where work of another kind begins that keeps nothing."""
    _held.clear()
    trim()


def trim() -> None:
    """Gives memory that a Python worker has freed back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def slices(batches, rows: int = 512):
    """Arrow batches in parts of so many rows, so that a worker holds few texts as Python objects."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def parts(batches, column: str, size: int = 1 << 22, rows: int = 4096):
    """Arrow batches in parts of about ``size`` bytes of a column and so many rows at most; a longer text is a part of its own."""
    for b in slices(batches, rows):
        upto, start = np.cumsum(pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while start < b.num_rows:
            before = upto[start - 1] if start else 0
            n = max(1, int(np.searchsorted(upto, before + size, side="right")) - start)
            yield b.slice(start, n)
            start += n


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, or longer ones where the table has such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names.

    Columns that the caller's table has besides can't clash with names that
    the operator uses itself.
    """
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))
