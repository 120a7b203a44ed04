"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridweave.llm.shared import dropped, saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (u > v).

    Large: every larger neighbour of u is linked with u's least neighbour.
    Small: u and its smaller neighbours are linked with the least of them.
    The least neighbour comes from an aggregate and a join, so a node that
    most others touch is not gathered in one task.
    """
    both = edges.select("u", "v")
    if large:
        both = both.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return out.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """node, component: for each node on an edge the least node reachable.

    Each round is written to the shared folder. The rounds end when both
    stars leave the edges as they are: each node is then linked with the
    least of its component. Nulls, loops and repeated edges are ignored.
    """
    now = saved(
        edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct(), "edges"
    )
    sum_of = F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    mark = now.agg(F.count("*").alias("n"), sum_of.alias("h")).first()
    for _ in range(max_rounds):
        if mark["n"] == 0:
            break
        after = saved(_star(_star(now, True), False), "edges")
        new = after.agg(F.count("*").alias("n"), sum_of.alias("h")).first()
        dropped(now)
        now, same, mark = after, new == mark, new
        if same:
            break
    else:
        raise RuntimeError(f"the components are not complete after {max_rounds} rounds")
    nodes = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.union(now.select("v", "v").distinct())
