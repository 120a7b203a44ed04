"""Sources and sinks of ensembles: NumPy archives, tables with metadata, delimited text."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def select_array(payload, key: str | None, name: str) -> np.ndarray:
    """The array of an archive: the named one, or the only one."""
    if isinstance(payload, np.ndarray):
        return payload
    if key is None and len(payload.files) != 1:
        raise ValueError(f"{name} holds {sorted(payload.files)}: name one")
    return payload[key or payload.files[0]]


def read_fields(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """path, sample_id, row, col, value of .npy and .npz files of [samples, rows, columns]; other suffixes raise.

    Each file is decoded in the task that reads it, field by field.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                if not name.endswith((".npy", ".npz")):
                    raise ValueError(f"{name} is neither .npy nor .npz")
                data = select_array(np.load(io.BytesIO(content), allow_pickle=False), key, name)
                if data.ndim != 3 or not np.isfinite(data).all():
                    raise ValueError(f"{name} is not a finite [samples, rows, columns] array")
                row, col = (x.ravel() for x in np.indices(data.shape[1:]))
                for i, field in enumerate(data):
                    n = field.size
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * n), pa.array(np.full(n, i)), pa.array(row.astype("i4")), pa.array(col.astype("i4")), pa.array(field.ravel().astype(float))],
                        ["path", "sample_id", "row", "col", "value"],
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, sample_id long, row int, col int, value double")


def read_table(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Columns of doubles from text that white space separates; lines with another number of fields raise."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("p"))
    sound = F.when(F.size("p") == len(names), F.col("p")).otherwise(F.raise_error(F.lit(f"a line has not {len(names)} fields")).cast("array<string>"))
    return lines.select(sound.alias("p")).select(*(F.col("p")[k].cast("double").alias(n) for k, n in enumerate(names)))


def write_with_metadata(df: DataFrame, path: str, metadata: dict, version: int = 1) -> None:
    """A Parquet table and, in its folder metadata, one JSON row; a reader checks the version."""
    df.write.parquet(f"{path}/data")
    text = json.dumps({**metadata, "schema_version": version, "rows": df.sparkSession.read.parquet(f"{path}/data").count()}, sort_keys=True)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/metadata")


def read_with_metadata(spark: SparkSession, path: str, version: int = 1) -> tuple[DataFrame, dict]:
    metadata = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    if metadata["schema_version"] != version:
        raise ValueError(f"version {metadata['schema_version']} is not {version}")
    return spark.read.parquet(f"{path}/data"), metadata


def write_csv(df: DataFrame, path: str) -> None:
    """Header and empty text for nulls."""
    df.write.option("header", True).option("nullValue", "").csv(path)
