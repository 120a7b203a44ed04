"""Substring dedup by sliding sentence spans.

Every run of ``width`` or, where they are short, more consecutive sentences
is hashed, both the shortest run from each sentence and the shortest one back
from it. Runs whose hash stands at several places are found by an aggregate
over all hashes, which also gives the first document of each. Sentences that
some non-first run covers are removed; what a removed run said stays at its
first place.

A sentence that is long is taken by its clauses, and a clause that stays long
by pieces whose ends its words decide, so that a passage without marks is cut
alike in any host. Texts are handled as words with the white space after
them: what a word says about the end of a sentence and its hash are looked up
once for each distinct word, and all else is array arithmetic over many texts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gridweave.llm.shared import free_names, held, parts, saved

#: Sentences and words that a span has at least.
WIDTH, LEAST_WORDS = 2, 25
#: Longer sentences, in words, are taken by clauses, and longer clauses by pieces.
LONG_WORDS = 30
#: Of so many gaps in a row between the words of a long clause, one at least is a cut.
WINDOW = 12
#: Scripts without blanks between words: each character counts as a word.
_SOLID = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
#: A word with the white space after it; white space before the first word goes with that.
_WORD = re.compile(rf"(?:^\s+)?(?:[^\s{_SOLID}]+|[{_SOLID}])\s*")
#: A sentence ends at a line end, or after end marks and closing quotes or brackets; a clause after these marks.
_MARKS, _CLOSING, _CLAUSE = ".!?…。！？", "\"'”’»)]", ",;:"
#: Distinct words that a worker keeps.
KEPT_WORDS = 1 << 19
#: Odd factors of the two polynomials whose values are a span's hash, and of the hash of a gap.
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: p is first sentence and sentences, q first and last character (each 32 bits), h0 and h1 the hash.
_ROW = "d long, v long, p long, q long, h0 long, h1 int"


class Words:
    """What is known of distinct words: two hashes, whether a sentence or a clause ends with it, its length with white space."""

    def __init__(self):
        self._places: dict[str, int] = {}
        self._rows = np.zeros((1 << 12, 5), np.uint64)

    def look(self, words: list[str]) -> np.ndarray:
        """A row of hash, hash, sentence end, clause end, length for each word."""
        places = self._places
        if len(places) > KEPT_WORDS:
            places.clear()
        new, n = [w for w in dict.fromkeys(words) if w not in places], len(places)
        if new:
            places.update(zip(new, range(n, n + len(new)), strict=True))
            if n + len(new) > len(self._rows):
                self._rows = np.concatenate((self._rows, np.zeros((n + len(new), 5), np.uint64)))
            bare, rows = [w.strip() for w in new], self._rows[n : n + len(new)]
            rows[:, :2] = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w.encode()) for w in bare]), ">u8").reshape(-1, 2)
            rows[:, 2] = [b[-1] in _MARKS or (b[-1] in _CLOSING and b.rstrip(_CLOSING).endswith(tuple(_MARKS))) or ("\n" in w and "\n" in w[len(w.rstrip()) :]) for w, b in zip(new, bare, strict=True)]
            rows[:, 3] = [b[-1] in _CLAUSE for b in bare]
            rows[:, 4] = list(map(len, new))
        return self._rows[np.fromiter(map(places.__getitem__, words), np.int64, len(words))]


def _groups(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each place, where groups end at the given places, and the sizes of the groups."""
    group = np.concatenate(([0], np.cumsum(ends)[:-1]))
    return group, np.bincount(group)


def _cuts(ends: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """ends, and besides the cuts in groups that are long: the gaps with the least hash of WINDOW gaps in a row, the last of equal ones."""
    group, sizes = _groups(ends)
    starts = np.cumsum(sizes) - sizes
    long = sizes[group] > LONG_WORDS
    n = len(ends)
    if n <= WINDOW or not long.any():
        return ends
    low = np.uint64((1 << 20) - 1)
    gaps = (first[:-1] * _FACTORS[0] ^ second[1:]) * _FACTORS[1]
    gaps = (gaps >> np.uint64(44) << np.uint64(20)) | (low - ((np.arange(n - 1) - starts[group[:-1]]).astype(np.uint64) & low))
    count = n - WINDOW  # windows of gaps, each about WINDOW + 1 words
    least = gaps[:count]
    for k in range(1, WINDOW):
        least = np.minimum(least, gaps[k : k + count])
    inside = long[:count] & (group[:count] == group[WINDOW:])
    cut = np.zeros(n, bool)
    for k in range(WINDOW):
        cut[k : k + count] |= inside & (gaps[k : k + count] == least)
    return ends | cut


def _sentence_ends(rows: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Whether a sentence, clause or piece ends with each word of consecutive texts."""
    last = np.ones(len(texts), bool)
    last[:-1] = texts[1:] != texts[:-1]
    ends = last | (rows[:, 2] > 0)
    group, sizes = _groups(ends)
    ends |= (rows[:, 3] > 0) & (sizes[group] > LONG_WORDS)
    return _cuts(ends, rows[:, 0], rows[:, 1])


def sentences(text: str) -> list[str]:
    """The sentences, or clauses of long ones, or pieces of long clauses; together they are the text, if it has words."""
    words = _WORD.findall(text)
    if not words:
        return []
    ends = np.nonzero(_sentence_ends(Words().look(words), np.zeros(len(words), np.int64)))[0] + 1
    return ["".join(words[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def spans(words: Words, texts: list[str], width: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The spans of some texts: text, first sentence, sentences, first and last (exclusive) character, two hashes; and the texts' sentences.

    From each sentence and back from each one the shortest run of ``width``
    sentences and ``least_words`` words. Words are compared as they are, white
    space isn't. Only a text with fewer than ``width`` sentences is one run.
    """
    split = [_WORD.findall(t) for t in texts]
    counts = np.array([len(w) for w in split])
    rows = words.look([w for s in split for w in s])
    owner = np.repeat(np.arange(len(texts)), counts)
    if not len(rows):
        return np.zeros((0, 7), np.int64), np.zeros(len(texts), np.int64)
    upto = np.nonzero(_sentence_ends(rows, owner))[0] + 1
    begin = np.concatenate(([0], upto[:-1]))
    doc = owner[begin]
    total = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(total) - total
    k = np.arange(len(upto))
    # Forward: the first sentence with whose end there are words enough. Back: the last one with whose start there are.
    to = np.maximum(np.searchsorted(upto, begin + least_words), k + width - 1)
    few = (total[doc] < width) & (k == first[doc]) & (counts[doc] >= least_words)
    to[few] = k[few] + total[doc[few]] - 1
    good = to < len(upto)
    good[good] = doc[to[good]] == doc[good]
    back = np.minimum(np.searchsorted(begin, upto - least_words, side="right") - 1, k - width + 1)
    ok = back >= 0
    ok[ok] = (doc[back[ok]] == doc[ok]) & (to[back[ok]] != k[ok])
    a, z = np.concatenate((k[good], back[ok])), np.concatenate((to[good], k[ok]))
    at, end = begin[a], upto[z]
    hashes = []
    for c, factor in enumerate(_FACTORS):
        ones = np.full(len(rows), factor, np.uint64)
        ones[0] = 1
        power = np.cumprod(ones)
        less = np.full(len(rows), pow(int(factor), -1, 1 << 64), np.uint64)
        less[0] = 1
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(rows[:, c] * power)))
        value = (sums[end] - sums[at]) * np.cumprod(less)[at] + (end - at).astype(np.uint64)
        value = (value ^ (value >> np.uint64(29))) * _FACTORS[1 - c]
        hashes.append((value ^ (value >> np.uint64(32))).view(np.int64))
    place = np.concatenate(([0], np.cumsum(rows[:, 4].astype(np.int64))))
    start = np.zeros(len(texts), np.int64)
    start[doc[::-1]] = place[begin[::-1]]
    own = doc[a]
    found = np.column_stack((own, a - first[own], z - a + 1, place[at] - start[own], place[end] - start[own], *hashes))
    return found, total


def _spans(docs: DataFrame, width: int, least_words: int) -> DataFrame:
    """A row for each span; p is negative and there is no hash where the text said the same before. And one with p alone, its sentences, for each text."""

    def run(batches):
        words = held("words of sentences", Words)
        for b in parts(batches, "text", 1 << 20, 256):
            texts = [t or "" for t in b.column("text").to_pylist()]
            found, total = spans(words, texts, width, least_words)
            found = found[np.lexsort((found[:, 1], found[:, 6], found[:, 5], found[:, 0]))]
            same = np.zeros(len(found), bool)
            same[1:] = (found[1:, [0, 5, 6]] == found[:-1, [0, 5, 6]]).all(axis=1)
            first = np.where(same, -1 - found[:, 1], found[:, 1])
            at = pa.array(np.concatenate((found[:, 0], np.arange(len(texts)))))
            none, only_p = np.concatenate((same, np.ones(len(texts), bool))), np.arange(len(at)) >= len(found)
            more = np.zeros(len(texts), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("d").take(at),
                    b.column("v").take(at),
                    pa.array(np.concatenate(((first << 32) | found[:, 2], total))),
                    pa.array(np.concatenate(((found[:, 3] << 32) | found[:, 4], more)), mask=only_p),
                    pa.array(np.concatenate((found[:, 5], more)), mask=none),
                    pa.array(np.concatenate((found[:, 6], more)).astype(np.int32), mask=none),
                ],
                ["d", "v", "p", "q", "h0", "h1"],
            )

    return docs.mapInArrow(run, _ROW)


def _keyed(df: DataFrame, id_col: str, text_col: str, d: str, v: str) -> DataFrame:
    """df with what a document is known by: its id, null ids last, and for null ids and ids with several texts the text's hash."""
    x = df.withColumns({d: F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit((1 << 63) - 1)), v: F.xxhash64(F.col(f"`{text_col}`"))})
    several = x.where(F.col(f"`{id_col}`").isNotNull()).groupBy(d).agg(F.min(v).alias("least"), F.max(v).alias("most")).where("least <> most").select(d)
    if several.isEmpty():
        return x.withColumn(v, F.when(F.col(f"`{id_col}`").isNull(), F.col(v)).otherwise(F.lit(0).cast("long")))
    (mark,) = free_names(x, "_several")
    x = x.join(several.withColumn(mark, F.lit(True)), d, "left")
    return x.withColumn(v, F.when(F.col(f"`{id_col}`").isNull() | F.col(mark), F.col(v)).otherwise(F.lit(0).cast("long"))).drop(mark)


def repeated_spans(docs: DataFrame, width: int = WIDTH, least_words: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """Of documents d, v, text: d, v, p, q of the spans that stand at an earlier place too; and the same of each document with its sentences as p, q null."""
    every = saved(_spans(docs, width, least_words), "spans")
    place = ["d", "v", "p", "q"]
    hashed = every.where("h0 is not null")
    # Partial aggregates meet here, not rows: a span that all documents share is no large group.
    several = hashed.groupBy("h0").agg(F.count("*").alias("size")).where("size > 1").select("h0")
    some = saved(hashed.join(several, "h0"), "repeated")
    first = saved(some.groupBy("h0", "h1").agg(F.min("d").alias("d1"), F.max("d").alias("d2"), F.min("v").alias("v1"), F.max("v").alias("v2")).where("d1 <> d2 or v1 <> v2").select("h0", "h1", "d1"), "first")
    met = some.join(first, ["h0", "h1"])
    later = met.where("d > d1").select(*place)
    # Of one id only texts told apart by v can follow each other.
    tied = met.where("d = d1 and v <> 0")
    least = tied.groupBy("h0", "h1").agg(F.min("v").alias("v1"))
    tied = tied.join(least, ["h0", "h1"]).where("v > v1").select(*place)
    within = every.where("p < 0 and q is not null").select(*place)
    return within.union(later).union(tied), every.where("q is null").select(*place)


def without_repeated_spans(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least_words: int = LEAST_WORDS
) -> DataFrame:
    """The rows of df with repeated spans removed from the text, and _n_sentences and _n_removed besides.

    The first span of each kind, by id and place, stays. Rows with one id and
    one text are one document and get the same result; rows with one id and
    different texts are ordered by the texts' hashes; null ids come last. Null
    texts stay null and empty ones empty, and texts of white space as they
    are, without sentences. An empty table gives no rows. Columns that the
    table has under the two added names are replaced.
    """
    df = df.drop("_n_sentences", "_n_removed")
    d, v, runs_col, total_col = free_names(df, "_d", "_v", "_runs", "_total")
    names = list(df.columns)
    x = _keyed(df, id_col, text_col, d, v)
    found, totals = repeated_spans(x.select(F.col(d).alias("d"), F.col(v).alias("v"), F.col(f"`{text_col}`").alias("text")), width, least_words)
    # One row for each document, so that the texts are joined once.
    run, both = F.when(F.col("q").isNotNull(), F.struct("p", "q")), found.union(totals)
    both = both.groupBy(F.col("d").alias(d), F.col("v").alias(v)).agg(F.collect_set(run).alias(runs_col), F.max(F.when(F.col("q").isNull(), F.col("p"))).cast("int").alias(total_col))
    x = x.join(both, [d, v], "left")

    def run(batches):
        for b in parts(batches, text_col, 1 << 22, 512):
            texts, gone = b.column(text_col), np.zeros(b.num_rows, np.int32)
            hit = np.nonzero(pc.list_value_length(b.column(runs_col)).fill_null(0).to_numpy(zero_copy_only=False))[0]
            if len(hit):
                rows = texts.to_pylist()
                for k in hit.tolist():
                    out, at, upto = [], 0, 0
                    runs = b.column(runs_col)[k].values
                    p, q = runs.field("p").to_numpy(), runs.field("q").to_numpy()
                    i, n = p >> 32, p & 0xFFFFFFFF
                    i = np.where(i < 0, -1 - i, i)
                    for j in np.lexsort((n, i)).tolist():
                        a, z, one, last = int(q[j] >> 32), int(q[j] & 0xFFFFFFFF), int(i[j]), int(i[j] + n[j])
                        if a > at:
                            out.append(rows[k][at:a])
                        at = max(at, z)
                        gone[k] += max(0, last - max(upto, one))
                        upto = max(upto, last)
                    rows[k] = "".join(out) + rows[k][at:]
                texts = pa.array(rows, pa.string())
            columns = [texts if c == text_col else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, b.column(total_col).fill_null(0), pa.array(gone)], [*names, "_n_sentences", "_n_removed"])

    schema = StructType([*df.schema, StructField("_n_sentences", IntegerType()), StructField("_n_removed", IntegerType())])
    return x.select(*(F.col(f"`{c}`") for c in names), total_col, runs_col).mapInArrow(run, schema)
