"""Moments of each cell that are updated as samples arrive and kept at given counts.

The state of a cell is count, mean, squared deviations, least and largest
value. Samples of a micro-batch are taken by their id, batches as they come.
Where a count is reached the state is emitted, and the stream goes on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "n long, mean double, m2 double, low double, high double"
SNAPSHOT = "row int, col int, count long, mean double, variance double, std double, min double, max double"


def moved(state: tuple, values: np.ndarray) -> tuple:
    """A state after more values, by the merge of two sets of moments."""
    n, mean, m2, low, high = state
    if not len(values):
        return state
    k, own = len(values), float(values.mean())
    total, gap = n + k, own - mean
    return total, mean + gap * k / total, m2 + float(((values - own) ** 2).sum()) + gap * gap * n * k / total, min(low, float(values.min())), max(high, float(values.max()))


def stepped(state: tuple, values: np.ndarray, checkpoints: list[int]) -> tuple[tuple, list[tuple]]:
    """The state after values in order, and (count, mean, variance, std, min, max) at each checkpoint on the way."""
    out = []
    for c in checkpoints:
        if state[0] < c <= state[0] + len(values):
            k = c - state[0]
            state, values = moved(state, values[:k]), values[k:]
            n, mean, m2, low, high = state
            variance = m2 / (n - 1) if n > 1 else None
            out.append((n, mean, variance, None if variance is None else variance**0.5, low, high))
    return moved(state, values), out


def snapshots(stream: DataFrame, checkpoints: list[int]) -> DataFrame:
    """row, col, count, mean, variance, std, min, max of a stream (sample_id, row, col, value) whenever a cell has one of the counts.

    Null values are no samples. A micro-batch's samples of one cell are held
    together in their task; the source's limit of files a trigger bounds them.
    """
    wanted = sorted(set(checkpoints))
    if not wanted or wanted[0] < 1:
        raise ValueError("checkpoints are counts from 1 up")

    def update(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(frames)).dropna(subset=["value"]).sort_values("sample_id", kind="stable")
        before = state.get if state.exists else (0, 0.0, 0.0, float("inf"), float("-inf"))
        after, rows = stepped(tuple(before), x["value"].to_numpy(float), wanted)
        state.update(after)
        yield pd.DataFrame([(*key, *r) for r in rows], columns=["row", "col", "count", "mean", "variance", "std", "min", "max"])

    return stream.select("sample_id", "row", "col", "value").groupBy("row", "col").applyInPandasWithState(update, SNAPSHOT, STATE, "append", GroupStateTimeout.NoTimeout)


def kept(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the snapshots of a stream to a table as they come."""
    return found.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
