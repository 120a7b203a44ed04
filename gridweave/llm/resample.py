"""Importance resampling towards a target text by hashed word n-grams.

A feature's bucket is the CRC-32 of its bytes. CRCs can be composed: the CRC
of a then b is the CRC of a, moved on by as many bytes as b has, xor the CRC
of b, and moving on by a fixed number of bytes is a linear map over GF(2). So
each distinct word's CRC is computed once, those of n-grams follow from those
of their words by such maps, and no n-gram is ever put together as a string.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gridweave.llm.lines import dense_ranks
from gridweave.llm.shared import only, parts, release, saved, trim

#: What stands between words, in texts of which A-Z are in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The polynomial of CRC-32, lowest bit last.
POLYNOMIAL = 0xEDB88320


def _apply(columns: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 32 by 32 matrix over GF(2), given by its columns as integers, times vectors: a table for each byte of them."""
    octets = np.arange(256)
    out = np.zeros(len(values), np.uint32)
    for k in range(4):
        bits = np.where((octets[:, None] >> np.arange(8)) & 1, columns[8 * k : 8 * k + 8], 0)
        out ^= np.bitwise_xor.reduce(bits, axis=1).astype(np.uint32)[(values >> np.uint32(8 * k)) & np.uint32(255)]
    return out


@cache
def shift_matrix(power: int) -> np.ndarray:
    """Columns of the map that moves a CRC on by 2^power bytes; power -3 is one bit."""
    if power == -3:
        return np.array([POLYNOMIAL, *(1 << k for k in range(31))], np.uint32)
    half = shift_matrix(power - 1)
    return _apply(half, half)


def combine(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of first parts followed by second parts of so many bytes, from the CRCs of both."""
    out, length = first.astype(np.uint32), np.asarray(length, np.int64)
    for power in range(int(length.max(initial=0)).bit_length()):
        moved = np.nonzero((length >> power) & 1)[0]
        out[moved] = _apply(shift_matrix(power), out[moved])
    return out ^ second.astype(np.uint32)


def ngram_crcs(words: np.ndarray, lengths: np.ndarray, document: np.ndarray, max_n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """document, CRC of all runs of 1, 2, ... max_n consecutive words of a document, joined by blanks; words by CRC and bytes."""
    blank, now = np.uint32(zlib.crc32(b" ")), words
    yield document, now
    for n in range(2, max_n + 1):
        starts = max(len(words) - n + 1, 0)
        spaced = combine(now[:starts], np.full(starts, blank), np.ones(starts, np.int64))
        now = combine(spaced, words[n - 1 :], lengths[n - 1 :])
        whole = document[:starts] == document[n - 1 :]
        yield document[:starts][whole], now[whole]


def _bucket_type(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def features(df: DataFrame, max_n: int, buckets: int) -> DataFrame:
    """doc_id, n_words, n_features and the features' buckets as packed integers, of doc_id, text."""
    kind = _bucket_type(buckets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in parts(batches, "text"):
            cut = pc.split_pattern_regex(pc.ascii_lower(b.column("text").cast(pa.string()).fill_null("")), BETWEEN)
            flat, who = cut.flatten(), pc.list_parent_indices(cut)
            full = pc.greater(pc.binary_length(flat), 0)
            coded, who = flat.filter(full).dictionary_encode(), who.filter(full).to_numpy()
            distinct = [w.encode() for w in coded.dictionary.to_pylist()]
            crc = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))
            size = np.fromiter(map(len, distinct), np.int64, len(distinct))
            at = coded.indices.to_numpy()
            words = np.bincount(who, minlength=b.num_rows)
            grams = list(ngram_crcs(crc[at], size[at], who, max_n))
            owner = np.concatenate([d for d, _ in grams])
            found = (np.concatenate([c for _, c in grams]) % np.uint32(buckets)).astype(kind)
            if max_n > 1:
                found = found[np.argsort(owner, kind="stable")]
            many = np.bincount(owner, minlength=b.num_rows)
            ends = np.cumsum(many)
            packed = [found[e - n : e].tobytes() for e, n in zip(ends.tolist(), many.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(words, pa.int64()), pa.array(many, pa.int64()), pa.array(packed, pa.binary())],
                ["doc_id", "n_words", "n_features", "buckets"],
            )
        trim()

    return df.mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary")


def bucket_counts(found: DataFrame, buckets: int) -> DataFrame:
    """bucket, n: how many features each bucket has; a task adds up its documents before anything is shuffled."""
    kind = _bucket_type(buckets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column("buckets"):
                total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=buckets)
        have = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array(total[have])], ["bucket", "n"])

    return found.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln of the smoothed share in the target over that in the corpus) of each bucket: as many numbers as there are buckets."""
    s, t = corpus.withColumnRenamed("n", "s"), target.withColumnRenamed("n", "t")
    both = s.join(t, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    sums = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    double = lambda x: x.cast("double")
    gain = F.floor(1000 * F.log(double(F.col("t") + 1) * float(sums["s"] + buckets) / (double(F.col("s") + 1) * float(sums["t"] + buckets))))
    out = np.full(buckets, int(np.floor(1000 * np.log(float(sums["s"] + buckets) / float(sums["t"] + buckets)))), np.int64)
    for row in both.select("bucket", gain.alias("gain")).collect():
        out[row["bucket"]] = row["gain"]
    return out


def _weighed(found: DataFrame, gain: np.ndarray, buckets: int) -> DataFrame:
    kind = _bucket_type(buckets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weight = [int(gain[np.frombuffer(x.as_buffer(), kind)].sum()) for x in b.column("buckets")]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resampled(
    df: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    max_n: int = 1,
    buckets: int = 10_000,
    least_words: int = 20,
    percent: int = 10,
    seed: str = "2024",
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row: importance weights by hashed n-grams, and a draw by Gumbel scores.

    A row's weight is the sum of its features' gains; its score adds noise
    that depends on seed and id only. Of the rows with ``least_words`` words
    ``percent`` % with the highest scores are drawn and ranked from 1, ties to
    the smaller id; rank is null for the others. Null and empty texts, and
    texts without words, have no features and weight 0. A null id counts as an
    empty one in the noise and stands first in ties; repeated rows each have a
    rank of their own. Without target texts gains are those of an empty
    target; an empty table gives no rows.
    """
    docs = only(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    wanted = only(target, text=target_col).select(F.lit(0).cast("long").alias("doc_id"), "text")
    found = saved(features(docs, max_n, buckets), "features")
    gain = gains(bucket_counts(found, buckets), bucket_counts(features(wanted, max_n, buckets), buckets), buckets)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296)))
    scored = _weighed(found, gain, buckets).withColumn("score", score.cast("long"))
    placed = dense_ranks(scored.select("doc_id", "n_features", "weight", "score", (F.col("n_words") < least_words).alias("_out"), (-F.col("score")).alias("_down")), "_out", "_down", "doc_id")
    drawn = found.where(F.col("n_words") >= least_words).count() * percent // 100
    rank = F.when(~F.col("_out") & (F.col("rank") <= drawn), F.col("rank"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
