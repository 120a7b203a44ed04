"""Connected regions of marked cells in fields of any size.

Cells go by tiles. A tile labels its own regions, each by its least cell; what
goes on over a tile's border is an edge between two labels. Only these edges
take part in the rounds that join regions of several tiles: every label takes
the least one it is linked with, and labels that have moved are followed, so
rounds are about the logarithm of the tiles that a region crosses.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gridweave.sources.places import own_place

MOST_ROUNDS = 64


def _tile_labels(x: pd.DataFrame) -> pd.DataFrame:
    """The least cell of each cell's region within its tile, by union of neighbours."""
    cells = sorted(set(zip(x["row"].tolist(), x["col"].tolist())))
    parent = {c: c for c in cells}

    def root(c):
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    for r, c in cells:
        for near in ((r - 1, c), (r, c - 1)):
            if near in parent:
                a, b = sorted((root((r, c)), root(near)))
                parent[b] = a
    found = [root(c) for c in cells]
    return pd.DataFrame({"sample_id": x["sample_id"].iloc[0], "row": [c[0] for c in cells], "col": [c[1] for c in cells], "top": [f[0] for f in found], "left": [f[1] for f in found]})


def _written(df: DataFrame, name: str) -> DataFrame:
    path = own_place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def labelled(cells: DataFrame, tile: int = 64) -> DataFrame:
    """sample_id, row, col, label (a struct of the least row and col of its region) of marked cells; neighbours share a side.

    Repeated cells count once; null keys take no part.
    """
    keyed = cells.select("sample_id", *(F.col(c).cast("int").alias(c) for c in ("row", "col"))).dropna().withColumns({f"_{c}": F.floor(F.col(c) / tile) for c in ("row", "col")})
    own = keyed.groupBy("sample_id", "_row", "_col").applyInPandas(lambda x: _tile_labels(x), "sample_id long, row int, col int, top int, left int")
    own = _written(own.select("sample_id", "row", "col", F.struct("top", "left").alias("label")), "tiles")
    edges = None
    for axis in ("row", "col"):
        border = own.where(F.pmod(F.col(axis), F.lit(tile)) == 0)
        before = own.where(F.pmod(F.col(axis), F.lit(tile)) == tile - 1).withColumn(axis, F.col(axis) + 1).withColumnRenamed("label", "other")
        one = border.join(before, ["sample_id", "row", "col"]).select("sample_id", F.greatest("label", "other").alias("u"), F.least("label", "other").alias("v"))
        edges = one if edges is None else edges.unionByName(one)
    edges = _written(edges.distinct(), "edges")
    if edges.isEmpty():
        return own
    links = edges.union(edges.select("sample_id", F.col("v").alias("u"), F.col("u").alias("v")))
    now = _written(links.groupBy("sample_id", "u").agg(F.least(F.col("u"), F.min("v")).alias("to")), "labels")
    for _ in range(MOST_ROUNDS):
        known = now.select("sample_id", F.col("u").alias("v"), F.col("to").alias("theirs"))
        near = links.join(known, ["sample_id", "v"]).groupBy("sample_id", "u").agg(F.min("theirs").alias("least"))
        hooked = now.join(near, ["sample_id", "u"]).select("sample_id", "u", F.least("to", "least").alias("to"), F.col("to").alias("was"))
        ahead = hooked.select("sample_id", F.col("u").alias("to"), F.col("to").alias("further"))
        after = _written(hooked.join(ahead, ["sample_id", "to"]).select("sample_id", "u", F.least("to", "further").alias("to"), "was"), "labels")
        moved = after.where("to <> was").limit(1).count()
        now = after.drop("was")
        if not moved:
            return own.join(now.select("sample_id", F.col("u").alias("label"), "to"), ["sample_id", "label"], "left").select("sample_id", "row", "col", F.coalesce("to", "label").alias("label"))
    raise RuntimeError(f"regions are not complete after {MOST_ROUNDS} rounds")


def centres(cells: DataFrame, tile: int = 64) -> DataFrame:
    """sample_id, y, x, cells of each region of marked cells: its centroid and size."""
    found = labelled(cells, tile).groupBy("sample_id", "label").agg(F.avg("row").alias("y"), F.avg("col").alias("x"), F.count("*").alias("cells"))
    return found.select("sample_id", "y", "x", "cells")
