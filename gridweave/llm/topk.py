"""Exact top-k inner products by a pivot-distance index.

Vectors are lifted by one coordinate, sqrt(M^2 - |v|^2) with M the longest
length; queries get 0 there. Then |q - v|^2 = |q|^2 + M^2 - 2 q.v, so the
largest products are the nearest lifted vectors, and the triangle inequality
holds. Each vector is keyed by its nearest pivot and its distance from it,
and the index is sorted by this key: an annulus about a pivot is a stretch
of consecutive rows.

A query first meets the annulus that it stands in itself, which gives its
k-th score so far and so a radius. From there it goes outward: annuli come in
the order of their least distance from the query that the triangle inequality
allows, in waves that double. The radius shrinks with what a wave finds, and
a query stops where all that is left lies beyond it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from gridweave.llm.shared import saved

#: Pivots, vectors in the sample that they are fitted on, and its rounds.
PIVOTS, SAMPLE, ROUNDS = 64, 4096, 5
#: Queries that go to the tasks together, and rows of an annulus searched at once.
CHUNK, ANNULUS = 16_384, 256


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    squares = (vectors * vectors).sum(axis=1)
    return np.column_stack((vectors, np.sqrt(np.maximum(longest - squares, 0))))


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (points * points).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * points @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def fit_pivots(sample: np.ndarray, k: int = PIVOTS, rounds: int = ROUNDS) -> np.ndarray:
    """Means of Lloyd's rounds, from sample rows that stand far from each other."""
    pivots = sample[:1]
    near = distances(sample, pivots)[:, 0]
    while len(pivots) < min(k, len(sample)) and near.max() > 0:
        pivots = np.vstack((pivots, sample[near.argmax()]))
        near = np.minimum(near, distances(sample, pivots[-1:])[:, 0])
    for _ in range(rounds):
        own = distances(sample, pivots).argmin(axis=1)
        pivots = np.array([sample[own == j].mean(axis=0) if (own == j).any() else p for j, p in enumerate(pivots)])
    return pivots


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, dim)


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; in doubles where these hold them exactly."""
    return a @ b.T if exact else (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)


def _keyed(vectors: DataFrame, dim: int, pivots: np.ndarray, longest: float) -> DataFrame:
    def run(batches):
        for b in batches:
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
            d = distances(lifted(flat.astype(float), longest), pivots)
            own = d.argmin(axis=1)
            rows = [r.tobytes() for r in flat]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int32()), pa.array(d[np.arange(len(own)), own]), b.column("vec_id"), pa.array(rows, pa.binary())],
                ["pivot", "r", "vec_id", "v"],
            )

    return vectors.mapInArrow(run, "pivot int, r double, vec_id long, v binary")


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then least id."""
    if len(ids) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.nonzero(scores >= kth)[0]
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def annuli(pivot: np.ndarray, r: np.ndarray) -> list[tuple[int, int]]:
    """First and last (exclusive) rows of the annuli of sorted rows: up to ``ANNULUS`` of one pivot."""
    cuts = np.concatenate(([0], np.nonzero(np.diff(pivot) | (np.diff(r) < 0))[0] + 1, [len(pivot)])) if len(pivot) else np.zeros(1, int)
    return [(a, min(a + ANNULUS, z)) for x, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) for a in range(x, z, ANNULUS)]


def _seeds(index: DataFrame, dim: int, every: int, k: int, wide: bool) -> DataFrame:
    """query_id, v, bound: the k-th score among the rows about the query's own place, null if there are fewer."""

    def run(batches):
        for b in batches:
            ids, pivot = b.column("vec_id").to_numpy(), b.column("pivot").to_numpy()
            at = np.nonzero(ids % every == 0)[0]
            if not len(at):
                continue
            v, bounds = _matrix(b.column("v"), dim), []
            for i in at.tolist():
                low, high = max(0, i - ANNULUS), i + ANNULUS
                near = np.nonzero(pivot[low:high] == pivot[i])[0] + low
                near = near[ids[near] != ids[i]]
                found = np.sort(_products(v[i : i + 1], v[near], wide)[0])
                bounds.append(int(found[-k]) if len(found) >= k else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(pa.array(at)), b.column("v").take(pa.array(at)), pa.array(bounds, pa.int64())], ["query_id", "v", "bound"]
            )

    return index.mapInArrow(run, "query_id long, v binary, bound long")


def _searched(index: DataFrame, dim: int, queries: list, pivots: np.ndarray, longest: int, k: int, wide: bool) -> DataFrame:
    """The best rows of each task's share of the index for each query of a chunk."""
    names = np.array([q["query_id"] for q in queries])
    packed = b"".join(bytes(q["v"]) for q in queries)
    seeds = np.array([np.iinfo(np.int64).min if q["bound"] is None else q["bound"] for q in queries])

    def run(batches):
        q = np.frombuffer(packed, np.int64).reshape(-1, dim)
        point = np.column_stack((q.astype(float), np.zeros(len(q))))
        d, squares = distances(point, pivots), (point * point).sum(axis=1)
        bound, held = seeds.copy(), [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in names]
        radius = np.full(len(q), np.inf)

        def shrink(at):
            square = squares[at] + longest - 2.0 * bound[at]
            radius[at] = np.where(bound[at] == np.iinfo(np.int64).min, np.inf, np.sqrt(np.maximum(square, 0)) * (1 + 1e-9) + 1e-6)

        def search(at, ids, v):
            scores = _products(q[at], v, wide)
            good = scores >= bound[at][:, None]
            for row in np.nonzero(good.any(axis=1))[0].tolist():
                j = at[row]
                use = np.nonzero(good[row] & (ids != names[j]))[0]
                if len(use):
                    i, x = np.concatenate((held[j][0], ids[use])), np.concatenate((held[j][1], scores[row][use]))
                    best = _best(i, x, k)
                    held[j] = (i[best], x[best])
                    if len(best) == k and x[best[-1]] > bound[j]:
                        bound[j] = x[best[-1]]
                        shrink(np.array([j]))

        shrink(np.arange(len(q)))
        for b in batches:
            ids, pivot, r = (b.column(c).to_numpy() for c in ("vec_id", "pivot", "r"))
            v = _matrix(b.column("v"), dim)
            rings = annuli(pivot, r)
            gap = np.column_stack([np.maximum(np.maximum(d[:, pivot[a]] - r[z - 1], r[a] - d[:, pivot[a]]), 0) for a, z in rings])
            nearness = np.empty_like(gap, dtype=np.int32)
            np.put_along_axis(nearness, gap.argsort(axis=1, kind="stable"), np.arange(len(rings), dtype=np.int32)[None], axis=1)
            done, wave = 0, 1
            while done < len(rings):
                for c, (a, z) in enumerate(rings):
                    at = np.nonzero((nearness[:, c] >= done) & (nearness[:, c] < done + wave) & (gap[:, c] <= radius))[0]
                    if len(at):
                        search(at, ids[a:z], v[a:z])
                done, wave = done + wave, done + wave
        sizes = [len(i) for i, _ in held]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(names, sizes)), pa.array(np.concatenate([i for i, _ in held])), pa.array(np.concatenate([x for _, x in held]))],
            ["query_id", "vec_id", "score"],
        )

    return index.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each row whose id is divisible by ``every``.

    Components are floor(scale * x), the score is their inner product, ties go
    to the smaller id, and rows with a query's own id are no answer. Null ids,
    null and empty vectors and vectors with null or non-finite components take
    no part. Vectors meet those of their own length. Repeated rows and several
    vectors of one id all count as rows; the different ones of a query's id ask
    together, and the k best of all their answers are given. With fewer than k others
    all are returned; an empty table gives no rows. Products have to fit into
    63 bits, else it raises. Only the two named columns are read.
    """
    spark = df.sparkSession
    x, whole = F.col(f"`{vector_col}`"), F.expr(f"not exists(`{vector_col}`, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    given = df.where(F.col(f"`{id_col}`").isNotNull() & x.isNotNull() & whole & (F.size(x) > 0))
    given = given.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    found = None
    for r in given.groupBy(F.size("v").alias("dim")).agg(F.max(length).alias("longest")).orderBy("dim").collect():
        part = _found(given.where(F.size("v") == r["dim"]), r["dim"], int(r["longest"]), k, every)
        if part is not None:
            found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(vectors: DataFrame, dim: int, longest: int, k: int, every: int) -> DataFrame | None:
    """query_id, vec_id, score: the k best rows at least of each query among vectors of one length; longest is their largest square."""
    if longest >= 2**62:
        raise ValueError("inner products of these vectors do not fit into 63 bits")
    wide, longest = longest >= 2**52, longest + (longest >> 50) + 1
    rows = vectors.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).collect()
    pivots = fit_pivots(lifted(np.array([r["v"] for r in rows], float), longest))
    keyed = _keyed(vectors, dim, pivots, longest)
    index = saved(keyed.repartitionByRange("pivot", "r", "vec_id").sortWithinPartitions("pivot", "r", "vec_id"), "index")
    seeds = saved(_seeds(index, dim, every, k, wide).groupBy("query_id", "v").agg(F.max("bound").alias("bound")), "seeds")
    chunks = -(-seeds.count() // CHUNK)
    found = None
    for c in range(chunks):
        queries = seeds.where(F.pmod(F.xxhash64("query_id", "v"), F.lit(chunks)) == c).collect() if chunks > 1 else seeds.collect()
        if queries:
            part = saved(_searched(index, dim, queries, pivots, longest, k, wide), "found")
            found = part if found is None else found.union(part)
    return found
