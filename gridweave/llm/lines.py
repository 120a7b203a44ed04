"""Line dedup by a suffix array over sequences of line ids.

Only lines that stand at several places matter: a line that occurs once ends
every repeated run. What is left are segments of consecutive repeated lines,
and their suffixes are sorted by prefix doubling: with ranks by the first
2^k lines, the pairs (own rank, rank 2^k lines on) give ranks by 2^(k+1).
Ranks are dense numbers from a range-partitioned sort of the distinct pairs,
so no group of equal suffixes has to meet in one task.

The longest common prefix of neighbours in the suffix array comes from the
ranks of all levels, largest first. Where it covers less than a run has to
have, one interval of the array ends and the next begins. All suffixes of an
interval start with the same run; the first by document and line keeps it,
and the lines that it covers at the others are deleted.

These are the shortest runs from each start. A maximal run can have short
lines after its last such start, and each of them ends a shortest run too: the
one back to the latest start that gives it enough characters. Those that
aren't shortest from their start as well are few. They are hashed as a whole
and counted. Each line of a maximal run is in a run of either kind, so both
add up to the maximal repeated run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gridweave.llm.shared import free_names, release, saved, slices, trim

#: Characters that a run has to have at least.
LEAST_CHARS = 25
#: Ranks in a stretch over which interval numbers are counted in one window.
STRETCH = 100_000
_POSITION = "d long, th long, i int"


def _lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """A row for each line: its document's key, its number, 128 bits of hash, and how many lines from it a run needs.

    back, t0, t1: lines and hash of the shortest run that ends with the line,
    null if there is none or it is the shortest from its start too.
    """

    def run(batches):
        release()
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part, who, place, high, low, reach, back, tails = b.slice(k, 256), [], [], [], [], [], [], []
                for r, text in enumerate(part.column("text").to_pylist()):
                    if not text:
                        continue
                    rows = text.split("\n")
                    digests = b"".join([xxhash.xxh3_128_digest(x.encode()) for x in rows])
                    both = np.frombuffer(digests, "<i8").reshape(-1, 2)
                    ends = np.cumsum([len(x) for x in rows])
                    before = np.concatenate(([0], ends[:-1]))
                    at = np.arange(len(rows))
                    reach.append(np.searchsorted(ends, before + least_chars) - at + 1)
                    start = np.searchsorted(before, ends - least_chars, side="right") - 1
                    tail = (start >= 0) & (start + reach[-1][start] - 1 < at)
                    back.append(np.where(tail, at - start + 1, 0))
                    tails += [xxhash.xxh3_128_digest(digests[16 * start[j] : 16 * (j + 1)]) for j in np.nonzero(tail)[0].tolist()]
                    who.append(np.full(len(rows), r))
                    place.append(np.arange(len(rows)))
                    high.append(both[:, 0])
                    low.append(both[:, 1])
                if not who:
                    continue
                at, back = pa.array(np.concatenate(who)), np.concatenate(back).astype("i4")
                ends_run, whole = back > 0, np.zeros((len(back), 2), "i8")
                whole[ends_run] = np.frombuffer(b"".join(tails), "<i8").reshape(-1, 2)
                last = [pa.array(x, mask=~ends_run) for x in (back, whole[:, 0].copy(), whole[:, 1].copy())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("d").take(at), part.column("th").take(at), *(pa.array(np.concatenate(x).astype(t)) for x, t in ((place, "i4"), (high, "i8"), (low, "i8"), (reach, "i4"))), *last],
                    ["d", "th", "i", "h0", "h1", "reach", "back", "t0", "t1"],
                )
        trim()

    return docs.mapInArrow(run, f"{_POSITION}, h0 long, h1 long, reach int, back int, t0 long, t1 long")


def dense_ranks(keys: DataFrame, *by: str) -> DataFrame:
    """Distinct keys with a column rank that numbers them from 1 in their order.

    Sorted by range; what stands before each partition is a sum over the
    partitions' counts, the only thing that passes the driver.
    """
    spark = keys.sparkSession
    ordered = keys.repartitionByRange(*by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()
    found = saved(ordered.select(*keys.columns, F.shiftright(at, 33).cast("int").alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_row")), "ranks")
    counts = sorted((r["_part"], r["n"]) for r in found.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before = np.cumsum([0, *(n for _, n in counts)]).tolist()
    offsets = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], "_part int, _before long")
    return found.join(F.broadcast(offsets), "_part").select(*keys.columns, (F.col("_before") + F.col("_row") + 1).alias("rank"))


def _segments(lines: DataFrame) -> DataFrame:
    """The repeated lines with their first rank and rem, the lines to the end of their segment."""
    place = F.struct("d", "th", "i")
    repeated = lines.groupBy("h0", "h1").agg(F.min(place).alias("a"), F.max(place).alias("z")).where("a <> z").select("h0", "h1")
    ids = dense_ranks(repeated, "h0", "h1")
    kept = lines.join(ids, ["h0", "h1"]).select("d", "th", "i", "reach", "rank").distinct()
    doc = W.partitionBy("d", "th")
    kept = kept.withColumn("s", F.col("i") - F.row_number().over(doc.orderBy("i")))
    seg = W.partitionBy("d", "th", "s")
    return kept.withColumn("rem", (F.max("i").over(seg) - F.col("i") + 1).cast("int")).select("d", "th", "i", "s", "reach", "rem", "rank")


def _doubled(now: DataFrame, step: int) -> DataFrame:
    ahead = F.lead("rank", step, 0).over(W.partitionBy("d", "th", "s").orderBy("i"))
    pairs = saved(now.withColumn("next", ahead), "pairs")
    ids = dense_ranks(pairs.select(F.col("rank").alias("own"), "next").distinct(), "own", "next")
    new = pairs.withColumnRenamed("rank", "own").join(ids, ["own", "next"])
    return saved(new.select("d", "th", "i", "s", "reach", "rem", "rank"), "level")


def suffix_array(segments: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The suffixes with their final ranks, and the ranks by the first 1, 2, 4, ... lines.

    Suffixes with the same lines up to their segments' ends keep one rank.
    """
    levels = [saved(segments, "level")]
    while True:
        step = 1 << (len(levels) - 1)
        open_ = levels[-1].groupBy("rank").agg(F.count("*").alias("n"), F.max("rem").alias("rem")).where(f"n > 1 and rem > {step}")
        if open_.isEmpty():
            return levels[-1], levels[:-1] or levels
        levels.append(_doubled(levels[-1], step))


def common_prefixes(array: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """rank, first position, reach, and lcp: the lines that it has in common with the rank before."""
    first_id = levels[0].select("d", "th", "i", F.col("rank").alias("line"))
    place = F.struct("d", "th", "i")
    blocks = array.groupBy("rank").agg(F.min(place).alias("at"), F.min(F.when(F.col("reach") <= F.col("rem"), F.col("reach"))).alias("reach"))
    blocks = saved(blocks.select("rank", "at.d", "at.th", "at.i", "reach").join(first_id, ["d", "th", "i"]), "blocks")
    before = blocks.select((F.col("rank") + 1).alias("rank"), *(F.col(c).alias(f"{c}0") for c in ("d", "th", "i", "line")))
    pairs = blocks.join(before, "rank").where("line = line0").select("rank", "d", "th", "i", "d0", "th0", "i0", F.lit(0).alias("lcp"))
    for k in range(len(levels) - 1, -1, -1):
        own = levels[k].select("d", "th", F.col("i").alias("_at"), F.col("rank").alias("ra"))
        other = levels[k].select(F.col("d").alias("d0"), F.col("th").alias("th0"), F.col("i").alias("_at0"), F.col("rank").alias("rb"))
        x = pairs.withColumns({"_at": F.col("i") + F.col("lcp"), "_at0": F.col("i0") + F.col("lcp")})
        x = x.join(own, ["d", "th", "_at"], "left").join(other, ["d0", "th0", "_at0"], "left")
        more = F.when(F.col("ra") == F.col("rb"), 1 << k).otherwise(0)
        pairs = saved(x.select("rank", "d", "th", "i", "d0", "th0", "i0", (F.col("lcp") + more).alias("lcp")), "lcp")
    return blocks.join(pairs.select("rank", "lcp"), "rank", "left").withColumn("lcp", F.coalesce("lcp", F.lit(0)))


def _intervals(prefixes: DataFrame) -> DataFrame:
    """rank, reach and the first position of the interval that starts with the same reach lines."""
    cut = F.when(F.col("lcp") < F.coalesce("reach", F.lit(1 << 30)), 1).otherwise(0)
    x = saved(prefixes.withColumns({"cut": cut, "stretch": F.floor(F.col("rank") / STRETCH)}), "cuts")
    sums = x.groupBy("stretch").agg(F.sum("cut").alias("n"))
    ahead = W.orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("stretch", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    x = x.join(sums, "stretch")
    x = x.withColumn("interval", F.col("ahead") + F.sum("cut").over(W.partitionBy("stretch").orderBy("rank")))
    x = x.where("reach is not null").select("rank", "reach", "interval", F.struct("d", "th", "i").alias("at"))
    first = x.groupBy("interval").agg(F.min("at").alias("first"))
    return x.join(first, "interval").select("rank", "reach", "first")


def _tails(lines: DataFrame) -> DataFrame:
    """d, th, i, n of the runs by their ends that stand earlier too."""
    runs = lines.where("back is not null").select("d", "th", (F.col("i") - F.col("back") + 1).alias("i"), F.col("back").alias("n"), "t0", "t1")
    place = F.struct("d", "th", "i")
    first = runs.groupBy("t0", "t1").agg(F.min(place).alias("first"), F.max(place).alias("z")).where("first <> z").select("t0", "t1", "first")
    return runs.join(first, ["t0", "t1"]).where(place > F.col("first")).select("d", "th", "i", "n")


def _key(id_col: str, text_col: str) -> dict[str, Column]:
    """What a document is known by; null ids stand last."""
    return {"d": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit((1 << 63) - 1)), "th": F.xxhash64(F.col(f"`{text_col}`"))}


def repeated_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, maximal: bool = False) -> DataFrame:
    """d, th, i, n: n lines from line i of a document stand earlier too, in an earlier document or above."""
    docs = df.select(*(c.alias(n) for n, c in _key(id_col, text_col).items()), F.col(f"`{text_col}`").alias("text"))
    lines = saved(_lines(docs, least_chars), "lines")
    array, levels = suffix_array(_segments(lines))
    runs = array.where("reach <= rem").join(_intervals(common_prefixes(array, levels)).select("rank", "first"), "rank")
    runs = runs.where(F.struct("d", "th", "i") > F.col("first")).select("d", "th", "i", F.col("reach").alias("n"))
    return runs.unionByName(_tails(lines)) if maximal else runs


def without_repeated_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, maximal: bool = False
) -> DataFrame:
    """The rows of df with repeated line runs deleted from the text, and _n_lines and _n_deleted besides.

    A line goes if it belongs to a run of lines of ``least_chars`` characters
    or more (without line ends) that stands at an earlier place: in a document
    with a smaller id, or further up; with ``maximal`` to the end of what both
    places share, else only as far as the shortest run from some line reaches,
    which leaves short last lines of a run in the text. Lines end at \\n alone and are compared
    as they are; blank lines count as part of runs. Rows with one id and one
    text are one document and get the same result; of rows with one id and
    different texts the order is fixed by the texts' hashes; null ids come
    last. A null text stays null with no lines, an empty one has one. An empty
    table gives no rows. Columns that the table has under the two added names
    are replaced.
    """
    df = df.drop("_n_lines", "_n_deleted")
    d, th, runs_col = free_names(df, "_d", "_th", "_runs")
    runs = repeated_runs(df, id_col, text_col, least_chars, maximal)
    runs = runs.groupBy(F.col("d").alias(d), F.col("th").alias(th)).agg(F.collect_set(F.struct("i", "n")).alias(runs_col))
    key = _key(id_col, text_col)
    x = df.withColumns({d: key["d"], th: key["th"]}).join(runs, [d, th], "left")
    text, all_lines = F.col(f"`{text_col}`"), F.split(F.col(f"`{text_col}`"), "\n", -1)
    x = x.withColumn("_n_lines", F.when(text.isNull(), 0).otherwise(F.size(all_lines)))
    names = list(df.columns)

    def run(batches):
        for b in slices(batches):
            texts, gone = b.column(text_col).to_pylist(), [0] * b.num_rows
            for k, found in enumerate(b.column(runs_col).to_pylist()):
                if found:
                    rows = texts[k].split("\n")
                    keep = np.ones(len(rows), bool)
                    for r in found:
                        keep[r["i"] : r["i"] + r["n"]] = False
                    gone[k] = int((~keep).sum())
                    texts[k] = "\n".join([x for x, stays in zip(rows, keep, strict=True) if stays])
            columns = [pa.array(texts, pa.string()) if c == text_col else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, b.column("_n_lines"), pa.array(gone, pa.int32())], [*names, "_n_lines", "_n_deleted"])

    schema = StructType([*df.schema, StructField("_n_lines", IntegerType()), StructField("_n_deleted", IntegerType())])
    return x.select(*(F.col(f"`{c}`") for c in names), runs_col, "_n_lines").mapInArrow(run, schema)
