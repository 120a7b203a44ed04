"""Comparison of distributions, histograms, covariances and response models."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridweave.operators.summaries import quantiles


def wasserstein(a: DataFrame, b: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Empirical W1 of two samples (column value) for each key: the integral of |F - G|.

    Values are counted first, so the window runs over distinct values of a key.
    """
    both = a.select(*by, "value", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(*by, "value", F.lit(0).alias("x"), F.lit(1).alias("y")))
    counts = both.groupBy(*by, "value").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    w, run = W.partitionBy(*by), W.partitionBy(*by).orderBy("value")
    gap = F.abs(F.sum("x").over(run) / F.sum("x").over(w) - F.sum("y").over(run) / F.sum("y").over(w))
    width = F.lead("value").over(run) - F.col("value")
    return counts.withColumn("part", gap * width).groupBy(*by).agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("w1"))


def histogram(df: DataFrame, low: float, high: float, bins: int, by: tuple[str, ...] = ()) -> DataFrame:
    """bin, count and density on shared edges; the last bin is closed on both sides."""
    width = (high - low) / bins
    inside = df.where((F.col("value") >= low) & (F.col("value") <= high))
    b = F.least(F.floor((F.col("value") - low) / width), F.lit(bins - 1)).cast("int")
    own = inside.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("count"))
    total = F.sum("count").over(W.partitionBy(*by))
    return own.withColumn("density", F.col("count") / (total * width))


def ecdf(df: DataFrame, edges: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """edge, share of values no larger, from one aggregate."""
    each = F.array(*(F.struct(F.lit(float(e)).alias("edge"), F.avg((F.col("value") <= e).cast("double")).alias("share")) for e in edges))
    return df.groupBy(*by).agg(each.alias("x")).select(*by, F.explode("x").alias("x")).select(*by, "x.edge", "x.share")


def marginal_validation(df: DataFrame, mean: float, std: float, low: float, high: float, tolerance: float) -> DataFrame:
    """Moments against a target, quantiles, shares inside and outside a range, pass or warn."""
    v = F.col("value")
    out = df.agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), (F.avg(v) - mean).alias("mean_error"), (F.stddev_samp(v) - std).alias("std_error"),
        quantiles("value", (0.01, 0.05, 0.5, 0.95, 0.99)).alias("q"), F.avg(v.between(low, high).cast("double")).alias("inside"), F.avg((v < low).cast("double")).alias("below"), F.avg((v > high).cast("double")).alias("above"),
    )
    status = F.when((F.abs("mean_error") <= tolerance) & (F.abs("std_error") <= tolerance), "pass").otherwise("warn")
    return out.withColumns({**{n: F.col("q")[k] for k, n in enumerate(("q01", "q05", "q50", "q95", "q99"))}, "status": status}).drop("q")


def normality(df: DataFrame) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis."""
    n = F.count("value").cast("double")
    g1, g2 = F.skewness("value"), F.kurtosis("value")
    return df.agg(
        F.count("value").alias("n"), (g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"), ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurtosis")
    )


def feature_reference(features: DataFrame, names: list[str]) -> DataFrame:
    """metric, mean, std (0 for one), min, max."""
    long = features.select(*names).unpivot([], names, "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def feature_comparison(generated: DataFrame, reference: DataFrame, names: list[str], eps: float = 1e-12) -> DataFrame:
    """Each metric of generated fields against the reference: z-score of the mean (null if its std is 0) and share outside its range."""
    ref = feature_reference(reference, names).withColumnsRenamed({"mean": "ref_mean", "std": "ref_std", "min": "ref_min", "max": "ref_max"})
    long = generated.select(*names).unpivot([], names, "metric", "value").join(F.broadcast(ref), "metric")
    outside = ((F.col("value") < F.col("ref_min")) | (F.col("value") > F.col("ref_max"))).cast("double")
    out = long.groupBy("metric", "ref_mean", "ref_std").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.avg(outside).alias("outside_fraction"))
    return out.withColumn("z_score", F.when(F.col("ref_std") > eps, (F.col("mean") - F.col("ref_mean")) / F.col("ref_std")))


def closest_by_features(generated: DataFrame, training: DataFrame, names: list[str]) -> DataFrame:
    """For each generated row (id) the nearest training row in standardized features; ties to the smaller id.

    Training fields are a bounded library of descriptors, sent to every task
    after a check of its size.
    """
    stats = training.agg(*(F.stddev_samp(n).alias(f"s_{n}") for n in names))
    t = training.select(F.col("id").alias("train_id"), *(F.col(n).alias(f"t_{n}") for n in names)).join(F.broadcast(stats))
    square = sum((((F.col(n) - F.col(f"t_{n}")) / F.col(f"s_{n}")) ** 2 for n in names), F.lit(0.0))
    near = generated.join(bounded(t)).select("id", "train_id", F.sqrt(square).alias("distance"))
    best = F.min(F.struct(F.round("distance", 12).alias("distance"), F.col("train_id"))).alias("x")
    return near.groupBy("id").agg(best).select("id", "x.train_id", "x.distance")


def probe_covariance(fields: DataFrame, probes: list[tuple[int, int]]) -> DataFrame:
    """a, b, covariance and correlation of probe cells over samples, from one row a sample."""
    wide = fields.groupBy("sample_id").agg(*(F.max(F.when((F.col("row") == r) & (F.col("col") == c), F.col("value"))).alias(f"p{k}") for k, (r, c) in enumerate(probes)))
    pairs = list(itertools.combinations_with_replacement(range(len(probes)), 2))
    each = F.array(*(F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), F.covar_samp(f"p{i}", f"p{j}").alias("covariance"), F.corr(f"p{i}", f"p{j}").alias("correlation")) for i, j in pairs))
    return wide.agg(each.alias("x")).select(F.explode("x").alias("x")).select("x.*")


#: Draws that a block has at least and at most, and rows that a library sent to every task may have.
PAIR_BLOCK, MOST_BLOCK, LIBRARY = 512, 2048, 100_000
#: Blocks that a task meets on either side, about, and draws of a tile's sides.
BLOCKS_MET, TILE = 4, (128, 512)


def _dealt_pairs(fields: DataFrame, block: int | None) -> DataFrame:
    """Each draw once (sample_id, row, col, value as arrays), with the block (own) that it is in."""
    cells = F.sort_array(F.collect_list(F.struct("row", "col", F.col("value").cast("double").alias("value"))))
    fields = fields.where("sample_id is not null")
    draws = fields.where("value is not null").groupBy("sample_id").agg(cells.alias("cells"))
    n = fields.select("sample_id").distinct().count()
    blocks = max(1, math.ceil(n / (block or min(max(math.ceil(n / 12), PAIR_BLOCK), MOST_BLOCK))))
    arrays = [F.col("cells.row").cast("array<int>").alias("row"), F.col("cells.col").cast("array<int>").alias("col"), F.col("cells.value").alias("value")]
    return draws.select("sample_id", *arrays, F.pmod(F.xxhash64("sample_id"), F.lit(blocks)).cast("int").alias("own"))


def _packed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block as one row: its draws in order, the cells that any of them has, their values, and which are there unless all are."""
    x = pa.Table.from_batches(batches).combine_chunks().sort_by("sample_id")
    ids = x["sample_id"].to_numpy()
    row, col, value = (pc.list_flatten(x[c]).to_numpy() for c in ("row", "col", "value"))
    draw = np.repeat(np.arange(len(ids)), pc.list_value_length(x["value"]).to_numpy())
    places, at = np.unique(np.column_stack((row, col)), axis=0, return_inverse=True)
    values, known = np.zeros((len(ids), len(places))), np.zeros((len(ids), len(places)), bool)
    values[draw, at.ravel()], known[draw, at.ravel()] = value, True
    one = lambda v, kind: pa.array([None if v is None else v.tobytes()], kind)
    yield pa.RecordBatch.from_arrays(
        [pa.array([key[0].as_py()], pa.int32()), *(one(v, pa.binary()) for v in (ids.astype(np.int64), places.astype(np.int64), values, None if known.all() else known))], ["own", "ids", "places", "v", "known"]
    )


def _blocks(fields: DataFrame, block: int | None) -> DataFrame:
    return _dealt_pairs(fields, block).groupBy("own").applyInArrow(_packed, "own int, ids binary, places binary, v binary, known binary")


def _paired_blocks(packs: DataFrame, fields: DataFrame, block: int | None) -> tuple[DataFrame, DataFrame]:
    """Each of the blocks with itself, and each pair of blocks (own <= own2) once, as rows of both.

    A draw is written once for either side, however many blocks there are:
    tasks of a Cartesian product read a few blocks of each.
    """
    blocks = math.ceil(fields.select("sample_id").distinct().count() / (block or PAIR_BLOCK))
    parts = max(min(blocks, 12), math.ceil(blocks * (block or PAIR_BLOCK) / MOST_BLOCK / BLOCKS_MET))
    again = [F.col(c).alias(f"{c}2") for c in packs.columns]
    left, right = packs.repartition(parts), packs.select(*again).repartition(parts)
    return packs.select("*", *again), left.hint("shuffle_replicate_nl").join(right, F.col("own") <= F.col("own2"))


class _Block:
    """A block's draws in order, and its cells as numbers."""

    def __init__(self, b: pa.RecordBatch, k: int, end: str):
        read = lambda c, kind: np.frombuffer(b.column(c + end)[k].as_buffer(), kind)
        self.own, self.ids, self.places = b.column("own" + end)[k].as_py(), read("ids", np.int64), read("places", np.int64).reshape(-1, 2)
        self.values = read("v", np.float64).reshape(len(self.ids), -1)
        self.known = read("known", bool).reshape(self.values.shape) if b.column("known" + end)[k].is_valid else None

    def cut(self, places: list[int]) -> None:
        self.places, self.values = self.places[places], self.values[:, places]
        self.known = None if self.known is None else self.known[:, places]


def _block_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[_Block, _Block]]:
    """Pairs of blocks, with the cells that both have."""
    for b in batches:
        for k in range(b.num_rows):
            one, two = _Block(b, k, ""), _Block(b, k, "2")
            if not np.array_equal(one.places, two.places):
                there = {tuple(p): i for i, p in enumerate(two.places.tolist())}
                common = [(i, there[tuple(p)]) for i, p in enumerate(one.places.tolist()) if tuple(p) in there]
                one.cut([i for i, _ in common])
                two.cut([j for _, j in common])
            yield one, two


def _tiles(one: _Block, two: _Block) -> Iterator[tuple[slice, slice, np.ndarray | None]]:
    """Rows and columns of tiles, and which pairs of a tile count, None for all."""
    for i in range(0, len(one.ids), TILE[0]):
        rows = slice(i, min(i + TILE[0], len(one.ids)))
        for j in range(0, len(two.ids), TILE[1]):
            columns = slice(j, min(j + TILE[1], len(two.ids)))
            if one.own != two.own or columns.start >= rows.stop:
                yield rows, columns, None
            elif columns.stop > rows.start + 1:
                yield rows, columns, np.arange(rows.start, rows.stop)[:, None] < np.arange(columns.start, columns.stop)


def _sides(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Two matrices whose product has |x - y|^2 of all rows, about the middle of x so that little is lost, and the largest |x|^2 + |y|^2."""
    with np.errstate(invalid="ignore", over="ignore"):
        middle = x.mean(axis=0)
        x, y = (v - np.where(np.isfinite(middle), middle, 0.0) for v in (x, y))
        s, t = ((v * v).sum(axis=1)[:, None] for v in (x, y))
    return np.hstack((-2 * x, s, np.ones_like(s))), np.hstack((y, np.ones_like(t), t)), float(s.max(initial=0) + t.max(initial=0))


def _square_tiles(one: _Block, two: _Block) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray | float, np.ndarray | None]]:
    """Tiles of a pair of blocks: which draws of either, sums of squares, numbers of cells that both have, and which pairs count, None for all."""
    whole = one.known is None and two.known is None
    if whole:
        p, q, _ = _sides(one.values, two.values)
    else:
        there = [np.ones_like(x.values) if x.known is None else x.known.astype(float) for x in (one, two)]
        v = [x.values if x.known is None else np.where(x.known, x.values, 0.0) for x in (one, two)]
        p, q = np.hstack((-2 * v[0], v[0] * v[0], there[0])), np.hstack((v[1], there[1], v[1] * v[1]))
    for rows, columns, wanted in _tiles(one, two):
        squares = p[rows] @ q[columns].T
        np.maximum(squares, 0, out=squares)
        both = float(len(one.places)) if whole else there[0][rows] @ there[1][columns].T
        if not whole or not both:
            some = np.broadcast_to(both > 0, squares.shape)
            wanted = some if wanted is None else wanted & some
        yield rows, columns, squares, both, wanted


def _rms(squares: np.ndarray, both: np.ndarray | float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.sqrt(squares / both)


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as Spark rounds doubles: halves of the shortest decimal away from zero; x is not negative."""
    scale = 10.0**digits
    moved = x * scale
    with np.errstate(invalid="ignore"):
        out = np.floor(moved + 0.5)
        unsure = np.flatnonzero(np.abs(out - moved) > 0.5 - 4e-16 * moved - 1e-12)
        out /= scale
        np.copyto(out, x, where=~(moved < 2.0**51))
    for k in unsure:
        if moved.flat[k] < 2.0**51:
            out.flat[k] = float(Decimal(repr(float(x.flat[k]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def pairwise_rms(fields: DataFrame, block: int | None = None, digits: int | None = None) -> DataFrame:
    """a, b (a < b), rms distance over the cells that both have, of all pairs of draws, rounded if digits are given.

    Draws are dealt into blocks, and each pair of blocks is products of
    matrices of some draws by some others, so a task holds a few blocks of
    draws and a tile of pairs at a time. The result has a row for each pair:
    that is what is asked for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, two in _block_pairs(batches):
            for rows, columns, squares, both, wanted in _square_tiles(one, two):
                a, b, rms = one.ids[rows][:, None], two.ids[columns], _rms(squares, both)
                a, b = np.minimum(a, b), np.maximum(a, b)
                a, b, rms = (x.ravel() if wanted is None else x[wanted] for x in (a, b, rms))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(rms if digits is None else half_up(rms, digits))], ["a", "b", "rms"])

    return _paired_blocks(_blocks(fields, block), fields, block)[1].mapInArrow(run, "a long, b long, rms double")


def _apart(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Root mean squares of the differences of rows i of x and j of y, each by itself: the same numbers wherever a pair is met."""
    out, step = np.empty(len(i)), max(1, (1 << 16) // x.shape[1])
    for k in range(0, len(i), step):
        d = x[i[k : k + step]] - y[j[k : k + step]]
        out[k : k + step] = np.einsum("ij,ij->i", d, d)
    return np.sqrt(out / x.shape[1])


def _ranged(batches: Iterable[pa.RecordBatch], low: float, high: float, rough: bool = False) -> Iterator[tuple[int, int, float, np.ndarray]]:
    """Tile by tile: pairs, how many of them have an rms up to low, the largest rms so far, and those above low and up to high.

    Single precision tells most pairs from the range by more than it can be
    wrong; the others are worked out from their differences. rough: all are
    taken from products, for a first look.
    """
    best = -1.0
    for one, two in _block_pairs(batches):
        n, x, y = len(one.places), one.values, two.values
        if rough or one.known is not None or two.known is not None or not n:
            for _, _, squares, both, wanted in _square_tiles(one, two):
                rms = _rms(squares, both)[wanted if wanted is not None else ...].ravel()
                best = max(best, float(rms.max(initial=-1.0)))
                yield len(rms), int(np.count_nonzero(rms <= low)), best, rms[(rms > low) & (rms <= high)]
            continue
        p, q, largest = _sides(x, y)
        if 1e-25 < largest < 1e30:
            p, q, slack = p.astype(np.float32), q.astype(np.float32), 4 * (n + 8) * 2.0**-24 * largest
        else:
            slack = 4 * (n + 8) * 2.0**-53 * largest
        least, most = (n * low * low * (1 - 1e-12) - slack if low > 0 else -math.inf), n * high * high * (1 + 1e-12) + slack
        for rows, columns, wanted in _tiles(one, two):
            squares = p[rows] @ q[columns].T
            if wanted is not None:
                # Pairs that don't count are taken for nearer than any.
                squares[~wanted] = -math.inf
            size = squares.size if wanted is None else int(np.count_nonzero(wanted))
            far = int(np.count_nonzero(squares > most))
            near = squares >= least
            near &= squares <= most
            if wanted is not None:
                near &= wanted
            rms = _apart(x[rows], y[columns], *np.divmod(np.flatnonzero(near), near.shape[1]))
            top = float(squares.max())
            bar = n * best * best * (1 - 1e-12) if best >= 0 else 0.0
            if size and top + slack >= bar:
                i, j = np.nonzero(squares >= max(top - 2 * slack, bar - slack))
                best = max(best, float(_apart(x[rows], y[columns], i, j).max(initial=-1.0)))
            yield size, size - far - len(rms) + int(np.count_nonzero(rms <= low)), best, rms[(rms > low) & (rms <= high)]


#: Bins of a pass over all pairs, and values of a range that are sorted as they are.
RMS_BINS, RMS_VALUES = 65_536, 1_000_000


def _binned(pairs: DataFrame, low: float, high: float, rough: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Edges of bins of a range, numbers of pairs of blocks up to the first, in each bin and above the last, and the largest rms."""
    edges = np.linspace(low, high, RMS_BINS + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, best, kept = np.zeros(len(edges) + 1, np.int64), -1.0, []

        def add(rms: np.ndarray) -> None:
            # A value's bin is the number of edges below it: that is what a range of edges, open below, selects.
            bins = np.clip(((rms - edges[0]) / (edges[-1] - edges[0]) * (len(edges) - 1)).astype(np.int64), 0, len(edges) - 2) + 1
            bins -= (bins > 1) & (rms <= edges[bins - 1])
            bins += (bins < len(edges) - 1) & (rms > edges[bins])
            found[:] += np.bincount(bins, minlength=len(found))

        for size, below, best, rms in _ranged(batches, edges[0], edges[-1], rough):  # noqa: B007
            found[0] += below
            found[-1] += size - below - len(rms)
            kept.append(rms)
            if len(kept) == 64:
                add(np.concatenate(kept))
                kept.clear()
        if kept:
            add(np.concatenate(kept))
        held = np.nonzero(found)[0]
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(found[held]), pa.array(np.full(len(held), best))], ["bin", "n", "top"])

    rows = pairs.mapInArrow(count, "bin long, n long, top double").groupBy("bin").agg(F.sum("n").alias("n"), F.max("top").alias("top")).collect()
    counts = np.zeros(len(edges) + 1, np.int64)
    for r in rows:
        counts[r["bin"]] = r["n"]
    return edges, counts, max((r["top"] for r in rows), default=-1.0)


def _about_middle(own: DataFrame, draws: int, low: float, high: float) -> tuple[float, float]:
    """A range that should hold the median of all pairs, from the pairs within blocks, in which every draw is."""
    share = 2 / math.sqrt(max(draws, 1)) + 1e-3
    for _ in range(3):
        edges, counts, _ = _binned(own, low, high, rough=True)
        run, total = np.cumsum(counts), int(counts.sum())
        first, last = (int(np.searchsorted(run, total * s)) for s in (max(0.5 - share, 0.0), min(0.5 + share, 1.0)))
        if not total or first == 0 or last >= len(edges):
            break
        low, high = float(edges[first - 1]), float(edges[last])
        if run[last] - run[first - 1] <= 2.5 * share * total:
            break
    return low, high


def pair_rms_summary(fields: DataFrame, block: int | None = None, most: int = RMS_VALUES) -> DataFrame:
    """median_rms, max_rms over all pairs of draws, exact, without a row for each pair.

    A pass counts the pairs in bins of their distance; the bins with the middle
    ranks are binned again until they hold few enough values to be sorted. The
    pairs within blocks tell where to look first: what is outside that range is
    only counted, and if the middle is not there, the whole range is binned.
    """
    largest, draws = fields.agg(F.max(F.abs(F.col("value").cast("double"))), F.approx_count_distinct("sample_id")).first()
    if largest is None or not math.isfinite(largest):
        return pairwise_rms(fields, block).agg(F.median("rms").alias("median_rms"), F.max("rms").alias("max_rms"))
    whole = (0.0, 2.0 * largest * (1 + 1e-9) + 1e-300)
    packs = _blocks(fields, block).persist()
    try:
        found = _middle(*_paired_blocks(packs, fields, block), draws, *whole, most)
    finally:
        packs.unpersist()
    return fields.sparkSession.createDataFrame([found], "median_rms double, max_rms double")


def _middle(own: DataFrame, pairs: DataFrame, draws: int, least: float, largest: float, most: int) -> tuple[float | None, float | None]:
    """The median and the largest rms of all pairs, which are up to ``largest``."""
    whole = (least, largest)
    low, high = _about_middle(own, draws, *whole)
    ranks, top = None, None
    while True:
        edges, counts, most_seen = _binned(pairs, low, high)
        if not counts.sum():
            return None, None
        if ranks is None:
            top, total = most_seen, int(counts.sum())
            ranks = (total - 1) // 2, total // 2
        run = np.cumsum(counts)
        first, last = (int(np.searchsorted(run, k, side="right")) for k in ranks)
        if (low, high) != whole and (first == 0 or last == len(edges)):
            low, high = whole
            continue
        inside, before = int(run[last] - run[first] + counts[first]), int(run[first] - counts[first])
        narrow = (float(edges[first - 1]) if first else -math.inf), (float(edges[last]) if last < len(edges) else math.inf)
        if inside <= most or not (math.isfinite(narrow[0]) and math.isfinite(narrow[1])) or narrow[1] - narrow[0] >= high - low or narrow[1] - narrow[0] < 1e-12 * largest:
            break
        low, high = narrow

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, rms in _ranged(batches, *narrow):
            if len(rms):
                yield pa.RecordBatch.from_arrays([pa.array(rms)], ["rms"])

    values = pairs.mapInArrow(listed, "rms double").groupBy("rms").agg(F.count("*").alias("n"))
    placed = values.withColumn("run", F.sum("n").over(W.orderBy("rms")) + before)
    middle = [F.min(F.when(F.col("run") > k, F.col("rms"))) for k in ranks]
    return placed.agg(((middle[0] + middle[1]) / 2).alias("median_rms")).first()[0], top


def bounded(library: DataFrame, most: int = LIBRARY) -> DataFrame:
    """A table to be sent to every task, after a check of its size."""
    if library.limit(most + 1).count() > most:
        raise ValueError(f"a table that every task needs whole has more than {most} rows")
    return F.broadcast(library)


def criteria(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Each criterion (null if unknown), and fail before unknown before pass."""
    known = {f"ok_{n}": F.abs(F.col(n)) <= t for n, t in limits.items()}
    failed = sum((F.coalesce((~c).cast("int"), F.lit(0)) for c in known.values()), F.lit(0))
    unknown = sum((c.isNull().cast("int") for c in known.values()), F.lit(0))
    status = F.when(failed > 0, "fail").when(unknown > 0, "unknown").otherwise("pass")
    return df.withColumns({**known, "status": status})


def scenario_matrix(spark, axes: dict[str, list]) -> DataFrame:
    """The product of independent axes, in their order; repeated values are refused."""
    out = None
    for name, values in axes.items():
        if len(set(values)) < len(values):
            raise ValueError(f"axis {name} repeats a value")
        each = F.explode(F.array(*map(F.lit, values))).alias(name)
        out = spark.range(1).select(each) if out is None else out.select("*", each)
    return out


def total_degree(spark, dimension: int, degree: int) -> DataFrame:
    """Multi-indices of at most a total degree, by degree and then in order.

    The bound goes into each step, so inadmissible ones are never made.
    """
    out = spark.range(1).select(F.array().cast("array<int>").alias("alpha"), F.lit(0).alias("degree"))
    for _ in range(dimension):
        out = out.select("alpha", "degree", F.explode(F.sequence(F.lit(0), F.lit(degree) - F.col("degree"))).alias("k"))
        out = out.select(F.concat("alpha", F.array(F.col("k").cast("int"))).alias("alpha"), (F.col("degree") + F.col("k")).cast("int").alias("degree"))
    return out


def normal_equations(df: DataFrame, basis: list[Column], target: Column) -> DataFrame:
    """i, j, gram and i, rhs sums of a least-squares fit, as one aggregate; j is null for the right side."""
    n = len(basis)
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.sum(basis[i] * basis[j]).alias("value")) for i in range(n) for j in range(i, n)]
    cells += [F.struct(F.lit(i).alias("i"), F.lit(None).cast("int").alias("j"), F.sum(basis[i] * target).alias("value")) for i in range(n)]
    return df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def solve_normal(sums: DataFrame) -> list[float]:
    """Coefficients from ``normal_equations``; one number a term passes the driver."""
    import numpy as np

    rows = sums.collect()
    n = 1 + max(r["i"] for r in rows)
    a, b = np.zeros((n, n)), np.zeros(n)
    for r in rows:
        if r["j"] is None:
            b[r["i"]] = r["value"]
        else:
            a[r["i"], r["j"]] = a[r["j"], r["i"]] = r["value"]
    if np.linalg.matrix_rank(a) < n:
        raise ValueError("the design has not full rank")
    return np.linalg.solve(a, b).tolist()


def predicted(basis: list[Column], coefficients: list[float]) -> Column:
    return sum((b * c for b, c in zip(basis, coefficients, strict=True)), F.lit(0.0))


def response_moments(coefficients: list[float]) -> tuple[float, float]:
    """Mean and variance of an orthonormal expansion."""
    return coefficients[0], math.fsum(c * c for c in coefficients[1:])


def energy_modes(spectrum_y: DataFrame, spectrum_x: DataFrame, share: float) -> DataFrame:
    """Products of two spectra (i, value) in falling order, up to the first that reaches a share of the whole.

    Spectra have one row a grid line, so their product is small.
    """
    both = spectrum_y.select(F.col("i").alias("iy"), F.col("value").alias("ly")).join(spectrum_x.select(F.col("i").alias("ix"), F.col("value").alias("lx")))
    w = W.orderBy(F.desc("energy"), "iy", "ix")
    x = both.withColumn("energy", F.col("ly") * F.col("lx"))
    x = x.withColumns({"mode": F.row_number().over(w), "_run": F.sum("energy").over(w.rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum("energy").over(W.partitionBy())})
    return x.where(F.col("_run") - F.col("energy") < share * F.col("_all")).select("mode", "iy", "ix", "energy")


def knots(df: DataFrame, count: int) -> DataFrame:
    """k, p, value: empirical quantiles at the middles of equal shares."""
    p = [(i + 0.5) / count for i in range(count)]
    q = df.agg(F.percentile("value", F.array(*map(F.lit, p))).alias("q"))
    return q.select(F.posexplode("q").alias("k", "value")).withColumn("p", (F.col("k") + 0.5) / count)


#: Weights that a task adds up for a place, about.
WEIGHTS = 4096


def simple_kriging_mean(queries: DataFrame, weights: DataFrame, mean: float, length: float) -> DataFrame:
    """id and posterior mean: mean + sum of weight times covariance (exponential) over observations.

    Every place that is asked for meets every place with weights, whose weights
    are added up first: the work is the product of the places, whatever the
    numbers of queries and observations. Weights are dealt into parts, each
    part's sums are added, and neither side is held whole anywhere.
    """
    asked = queries.select(F.col("x_m").alias("_x"), F.col("y_m").alias("_y")).distinct()
    known = weights.groupBy("ox", "oy").agg(F.sum("alpha").alias("alpha"))
    parts = max(1, math.ceil(known.count() / WEIGHTS))
    dealt = known.withColumn("part", F.pmod(F.xxhash64("ox", "oy"), F.lit(parts)).cast("int"))
    d = F.sqrt((F.col("_x") - F.col("ox")) * (F.col("_x") - F.col("ox")) + (F.col("_y") - F.col("oy")) * (F.col("_y") - F.col("oy")))
    # Places go in slices besides, so that few parts are still many tasks.
    slices = 64
    each = asked.select("_x", "_y", F.pmod(F.xxhash64("_x", "_y", F.lit(1)), F.lit(slices)).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    dealt = dealt.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    each, dealt = (x.repartition(slices, "part", "slice") for x in (each, dealt))
    sums = each.join(dealt.hint("merge"), ["part", "slice"]).groupBy("_x", "_y").agg(F.sum(F.col("alpha") * F.exp(-d / length)).alias("total"))
    same = F.col("x_m").eqNullSafe(F.col("_x")) & F.col("y_m").eqNullSafe(F.col("_y"))
    return queries.join(sums.hint("merge"), same).groupBy("id").agg((F.lit(mean) + F.sum("total")).alias("mean"))
