"""Checks that fail loudly instead of dropping rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def bad(value: Column, positive: bool = False) -> Column:
    """Whether a value is null, not finite or, if asked for, not positive."""
    found = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return found | (value <= 0) if positive else found


def violations(df: DataFrame, column: str = "value", positive: bool = True) -> DataFrame:
    """One row: rows and violations."""
    count = F.count_if(bad(F.col(column), positive))
    return df.agg(F.count("*").alias("rows"), count.alias("violations"))


def guarded(df: DataFrame, column: str = "value", positive: bool = False) -> DataFrame:
    """df; reading a bad value raises an error in the task that meets it."""
    fail = F.raise_error(F.lit(f"{column} is not finite" + " and positive" * positive)).cast("double")
    return df.withColumn(column, F.when(bad(F.col(column), positive), fail).otherwise(F.col(column)))


def outside_grid(cells: DataFrame, height: int, width: int) -> DataFrame:
    """Cells (row, col) that are not on the grid; has to be empty."""
    return cells.where(~(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)))


def permutation_check(df: DataFrame, id_col: str) -> DataFrame:
    """One row: whether ids are 1 to n, each once."""
    x = F.col(id_col)
    return df.agg(F.count("*").alias("n"), ((F.count("*") == F.count_distinct(x)) & (F.min(x) == 1) & (F.max(x) == F.count("*"))).alias("complete"))
