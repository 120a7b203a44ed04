"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected the same number of times, its source's
target over its source's size. Documents stand in a fixed order; the running
sum of expected copies, with one offset for each source, gives a document one
copy for each integer boundary that it crosses. The order goes by size, so
that the words taken follow the target closely, then by a hash of the id.

The running sum of a source doesn't come from one window over its rows: rows
are counted in buckets that follow the order, the buckets' counts are summed,
and windows run within buckets. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridweave.llm.shared import free_names, saved

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: A target is at most so many times its source's size.
MOST = 3
#: Columns that ``mixed`` adds.
ADDED = ("_size", "_source_size", "_target", "_copies")
#: Rows of a bucket of the largest source and size class, about.
BUCKET_ROWS = 50_000


def word_count(text: Column) -> Column:
    """The number of [^\\x20\\x09-\\x0D]+ in a text; 0 if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """A number that grows with the size: its bit length and next three bits."""
    bits = F.length(F.bin(size))
    return bits * 8 + F.floor(size / F.pow(F.lit(2.0), F.greatest(bits - 4, F.lit(0)))).cast("long") % 8


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """_null, _source, source_size, target of a table of the first three.

    Sources stand by code point, null last. All sizes together are shared by
    weight; targets stop at ``most`` times their source's size and the rest is
    shared by weight among the others, until none is above. That is
    least(most * size, level * weight) with the one level whose targets sum up
    to the whole; it is found by the order in which sources reach their limit.
    The windows run over one row for each source.
    """
    order = W.orderBy("_null", "_source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    x = sizes.select("_null", "_source", "source_size", weight.cast("long").alias("weight"))
    every = W.partitionBy()
    full = W.orderBy(F.col("source_size") / F.col("weight"), "_null", "_source")
    before = full.rowsBetween(W.unboundedPreceding, -1)
    total, heavy = F.sum("source_size").over(every), F.sum("weight").over(every)
    left = total - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = left / (heavy - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    x = x.withColumn("level", level)
    holds = F.col("level") * F.col("weight") <= most * F.col("source_size")
    x = x.withColumn("level", F.min(F.when(holds, F.struct(F.col("source_size") / F.col("weight"), "level"))).over(every)["level"])
    target = F.least(most * F.col("source_size").cast("double"), F.col("level") * F.col("weight"))
    return x.select("_null", "_source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mixed(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    seed: str = "mix",
    texts: bool = True,
) -> DataFrame:
    """The rows of df with _size, _source_size, _target and _copies besides; without ``texts`` the text column is left out.

    _copies says how often the mix takes the row, 0 to ``most`` times. Null
    sources are one source, the last. Null and wordless texts have size 0:
    they are taken as often as others and add nothing; a source of such texts
    alone has the target 0 and none of its rows is taken. Rows with the same
    id stand next to each other and count as rows of their own; those with a
    null id stand by their texts. An empty table gives no rows. Reruns take
    the same copies. Columns that the table has under the added names are
    replaced.
    """
    df = df.drop(*ADDED)
    null, name, hashed, klass, content, part, place, ahead, n = free_names(
        df, "_null", "_source", "_hash", "_class", "_content", "_part", "_place", "_ahead", "_n"
    )
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`")
    names = [c for c in df.columns if texts or c != text_col]
    # A source is two columns without nulls, to group, sort and join by.
    who = F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), text, F.lit("")))
    of_text = [word_count(text).alias("_size"), source.isNull().alias(null), F.coalesce(source.cast("string"), F.lit("")).alias(name), who.alias(hashed)]
    # Counts come from a narrow table, made in one pass over the texts; so do the rows where no text is wanted.
    own = [] if texts else [*(F.col(f"`{c}`") for c in names), F.xxhash64(text).alias(content)]
    slim = saved(df.select(*own, *of_text), "sizes")
    rows = df.select(*(F.col(f"`{c}`") for c in names), F.xxhash64(text).alias(content), *of_text) if texts else slim

    known = saved(slim.groupBy(F.col(null).alias("_null"), F.col(name).alias("_source")).agg(F.sum("_size").alias("source_size"), F.count("*").alias("rows")), "sources")
    largest = known.agg(F.max("rows")).first()[0] or 1
    digits = max(1, math.ceil(math.log(max(1, largest / BUCKET_ROWS), 16)))
    goal = targets(known, weights, most).select(
        F.col("_null").alias(null), F.col("_source").alias(name), F.col("source_size").alias("_source_size"), F.col("target").alias("_target")
    )

    parts = {klass: size_class(F.col("_size")), part: F.substring(hashed, 1, digits)}
    rows = rows.withColumns(parts)
    bucket = [null, name, klass, part]
    before = W.partitionBy(null, name).orderBy(klass, part).rowsBetween(W.unboundedPreceding, -1)
    counts = slim.withColumns(parts).groupBy(*bucket).agg(F.count("*").alias(n))
    counts = counts.select(*bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(ahead))
    within = W.partitionBy(*bucket).orderBy(hashed, F.col(f"`{id_col}`"), content)
    rows = rows.join(counts, bucket).withColumn(place, F.col(ahead) + F.row_number().over(within))

    rate = F.when(F.col("_source_size") > 0, F.least(F.col("_target") / F.col("_source_size"), F.lit(float(most)))).otherwise(0.0)
    key = F.concat(F.lit(f"{seed}:"), F.when(F.col(null), "-").otherwise(F.concat(F.lit("+"), F.col(name))))
    offset = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / float(1 << 48)
    crossed = F.floor(F.col(place) * rate + offset) - F.floor((F.col(place) - 1) * rate + offset)
    out = rows.join(goal, [null, name]).withColumn("_copies", crossed.cast("int"))
    return out.select(*(F.col(f"`{c}`") for c in names), *ADDED)


def emitted(df: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of df, each as often as it is taken."""
    rows = mixed(df, **options).where("_copies > 0")
    names, (copy,) = [F.col(f"`{c}`") for c in df.columns if c not in ADDED], free_names(df, "_copy")
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), "_copies"))).select(*names)
