"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary.
The probability of a word is the sum over all its segmentations into pieces,
by the forward algorithm; a text's is the product over its words. Piece
probabilities are learned by expectation maximisation from labelled rows:
forward and backward sums give each piece's expected count.

Words are runs of letters, in lower case, with the vocabulary's mark of a
word's start in front. Spark counts the words, runs the expectation step and
sums the counts; only probabilities, languages times pieces, pass the driver.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from gridweave.llm.shared import held, saved, slices, trim


def _numerals(last: int) -> str:
    """What re counts as part of a word though it is neither a letter nor a decimal digit: fractions, superscripts, Roman numerals."""
    return "".join(c for c in map(chr, range(last)) if c.isnumeric() and not (c.isalpha() or c.isdecimal()))


_WORD = re.compile(r"[^\W\d_]+")
#: Such numerals, rare in texts, and a quick way to see that there may be some.
_NUMERALS = re.compile(f"[{_numerals(sys.maxunicode + 1)}]+")
_MAYBE = re.compile(f"[{_numerals(1 << 16)}\U00010000-\U0010ffff]")
START = "▁"
#: Probability of a character that is no piece, in every language, and of a piece that a language never needed, in counts.
UNKNOWN, SMOOTHING = 1e-7, 0.01
#: A factor for each character that keeps forward sums near 1; the sums are divided by it in the end.
LIFT = 12.0
#: Words whose scores a task keeps, the first it meets; texts scored together.
KEPT_WORDS, TOGETHER = 1 << 17, 512
#: Longer words are gone through one by one, place by place.
LONG = 256
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Pieces:
    """The vocabulary, looked up by hashes of code points for many words at once."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [k for k in range(model.get_piece_size()) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))]
        words = sorted({model.id_to_piece(k) for k in plain})
        #: Row 0 is no piece, row 1 an unknown character.
        self.size, self.longest = len(words) + 2, max(map(len, words))
        hashes = np.zeros(len(words), np.uint64)
        for n in {len(w) for w in words}:
            at = [k for k, w in enumerate(words) if len(w) == n]
            points = self.points([words[k] for k in at])
            h = np.zeros(len(at), np.uint64)
            for c in points:
                h = self._more(h, c)
            hashes[at] = h
        self.lengths = np.array([1, 1, *map(len, words)])
        self._tables, left = [], np.arange(len(words))
        for shift in (44, 43, 42):  # a table for what collided in those before
            slots, table = hashes[left] * _MIX >> np.uint64(shift), np.zeros(1 << (64 - shift), np.int32)
            _, first = np.unique(slots, return_index=True)
            table[slots[first]] = left[first] + 2
            self._tables.append((np.uint64(shift), table))
            left = np.delete(left, first)
        if len(left) or len(np.unique(hashes)) < len(words):
            raise ValueError("pieces collide")
        self._hashes = np.concatenate((np.array([0, 0], np.uint64), hashes))

    @staticmethod
    def points(words: list[str]) -> np.ndarray:
        """Code points of words of one length: a row for each place."""
        return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).T.astype(np.uint64)

    @staticmethod
    def _more(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (h + c + np.uint64(1)) * _BASE

    def _look(self, h: np.ndarray) -> np.ndarray:
        out, mixed = np.zeros(h.shape, np.int32), h * _MIX
        for shift, table in self._tables:
            got = table[mixed >> shift]
            np.copyto(out, got, where=(got > 0) & (self._hashes[got] == h))
        return out

    def edges(self, words: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """For words of one length, by start and end, each word's piece there, 0 if none."""
        points = self.points(words)
        n, out = len(points), {}
        h = np.zeros_like(points)
        for size in range(1, min(n, self.longest) + 1):
            h = self._more(h[: n - size + 1], points[size - 1 :])
            found = self._look(h)
            if size == 1:
                found[found == 0] = 1
            used = found.any(axis=1)
            out.update(((k, k + size), found[k]) for k in np.nonzero(used)[0].tolist())
        return out

    def found(self, word: str) -> np.ndarray:
        """(start, size - 1): the piece of a word that starts there and has this size, 0 if none."""
        points = self.points([word])[:, 0]
        n, h = len(points), np.zeros(len(points), np.uint64)
        out = np.zeros((n, self.longest), np.int32)
        for size in range(1, min(n, self.longest) + 1):
            h = self._more(h[: n - size + 1], points[size - 1 :])
            out[: n - size + 1, size - 1] = self._look(h)
        out[out[:, 0] == 0, 0] = 1
        return out

    def long_forward(self, word: str, p: np.ndarray, step: int = 1 << 14) -> np.ndarray:
        """The logs of a word's last forward sums by language, in windows of the longest piece: its length costs no memory."""
        last, logs = np.zeros((self.longest, p.shape[1])), np.zeros(p.shape[1])
        last[-1] = 1  # sums of the places before, the nearest last
        for k in range(0, len(word), step):
            around = word[max(0, k - self.longest + 1) : k + step]
            ahead, found = k - max(0, k - self.longest + 1), self.found(around)
            for e in range(ahead, len(around)):
                sizes = np.arange(1, min(self.longest, e + 1) + 1)
                now = (last[-sizes] * p[found[e + 1 - sizes, sizes - 1]]).sum(axis=0)
                last[:-1] = last[1:]
                last[-1] = now
                if e % 32 == 0:
                    top = np.maximum(now, 1e-250)
                    last /= top
                    logs += np.log(top)
        return np.log(np.maximum(last[-1], 1e-300)) + logs - len(word) * np.log(LIFT)

    def long_counts(self, word: str, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in all segmentations of one long word; p is of one language and lifted."""
        n, found = len(word), self.found(word)
        chances, total = np.where(found > 0, p[found], 0.0), np.zeros(self.size)
        a, b, up, down = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
        a[0] = b[n] = 1

        def near_one(x, logs, at, low, high):
            top = max(x[at], 1e-250)
            x[low:high] /= top
            logs[low:high] += np.log(top)

        # Scaled sums and the logs of their scales; sums that meet in one step have one scale.
        for e in range(1, n + 1):
            sizes = np.arange(1, min(self.longest, e) + 1)
            a[e], up[e] = (a[e - sizes] * chances[e - sizes, sizes - 1]).sum(), up[e - 1]
            if e % 32 == 0:
                near_one(a, up, e, max(0, e - self.longest), e + 1)
        for s in range(n - 1, -1, -1):
            sizes = np.arange(1, min(self.longest, n - s) + 1)
            b[s], down[s] = (b[s + sizes] * chances[s, sizes - 1]).sum(), down[s + 1]
            if s % 32 == 0:
                near_one(b, down, s, s, min(n, s + self.longest) + 1)
        whole = np.log(max(a[n], 1e-300)) + up[n]
        for size in range(1, self.longest + 1):
            at = np.nonzero(found[: n - size + 1, size - 1])[0]
            use = a[at] * chances[at, size - 1] * b[at + size] * np.exp(up[at] + down[at + size] - whole)
            total += np.bincount(found[at, size - 1], use, self.size)
        return total

    def lifted(self, p: np.ndarray) -> np.ndarray:
        """Probabilities (pieces, languages) times LIFT for each character."""
        return p * LIFT ** self.lengths[:, None]

    def forward(self, edges: dict, n: int, p: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Forward sums (place, word, language), each scaled, and the logs of the last ones."""
        a, logs = np.zeros((n + 1, count, p.shape[1])), np.zeros(count)
        a[0] = 1
        into: list[list] = [[] for _ in range(n + 1)]
        for (s, e), piece in edges.items():
            into[e].append((s, piece))
        for e in range(1, n + 1):
            for s, piece in into[e]:
                a[e] += a[s] * p[piece]
            if e % 32 == 0:
                top = np.maximum(a[e].max(axis=1), 1e-250)
                a[max(0, e - self.longest) : e + 1] /= top[:, None]
                logs += np.log(top)
        return a, np.log(np.maximum(a[n], 1e-300)) + logs[:, None] - n * np.log(LIFT)


def _by_length(words: list[str]) -> list[list[int]]:
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w), []).append(k)
    return [g[k : k + 4000] for g in groups.values() for k in range(0, len(g), 4000)]


class Scorer:
    """Log probabilities of words in each language."""

    def __init__(self, model_file: str, p: np.ndarray):
        self.pieces = Pieces(model_file)
        self._p = self.pieces.lifted(p)
        self._place: dict[str, int] = {}
        self._kept = np.zeros((1024, p.shape[1]))

    def words(self, words: list[str]) -> np.ndarray:
        out, marked = np.zeros((len(words), self._p.shape[1])), [START + w for w in words]
        for at in _by_length(marked):
            own = [marked[k] for k in at]
            if len(own[0]) > LONG:
                out[at] = [self.pieces.long_forward(w, self._p) for w in own]
                continue
            out[at] = self.pieces.forward(self.pieces.edges(own), len(own[0]), self._p, len(own))[1]
        return out

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """Of each text the sums over its words; nan without words."""
        units, place = [words_of(t) for t in texts], self._place
        new = [w for w in set(chain.from_iterable(units)) if w not in place]
        scores, held = self.words(new), len(place)
        if held + len(new) > len(self._kept):
            more = np.zeros((held + len(new), self._kept.shape[1]))
            self._kept = np.concatenate((self._kept, more))
        self._kept[held : held + len(new)] = scores
        place.update(zip(new, range(held, held + len(new)), strict=True))
        out = np.full((len(texts), self._kept.shape[1]), np.nan)
        for k, us in enumerate(units):
            if us:
                out[k] = self._kept[np.fromiter(map(place.__getitem__, us), np.int64, len(us))].sum(axis=0)
        if len(place) > KEPT_WORDS:
            for w in new:
                del place[w]
        return out


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text in lower case."""
    low = text.lower() if text else ""
    words = _WORD.findall(low)
    if not low.isascii() and _MAYBE.search(low):
        words = [part for w in words for part in _NUMERALS.split(w) if part]
    return words


def _word_counts(rows: DataFrame) -> DataFrame:
    def run(batches):
        for b in slices(batches):
            counts: Counter = Counter()
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                counts.update((lang, w) for w in words_of(text))
            yield pa.RecordBatch.from_pydict(
                {"lang": [k[0] for k in counts], "word": [k[1] for k in counts], "n": list(counts.values())},
                pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]),
            )

    return rows.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def expected_counts(pieces: Pieces, words: list[str], n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in all segmentations of words that come n times; p is of one language."""
    total, lifted, marked = np.zeros(pieces.size), pieces.lifted(p[:, None]), [START + w for w in words]
    for at in _by_length(marked):
        own, weight = [marked[k] for k in at], n[at].astype(float)
        size = len(own[0])
        if size > LONG:
            for w, times in zip(own, weight, strict=True):
                total += times * pieces.long_counts(w, lifted[:, 0])
            continue
        edges = pieces.edges(own)
        a, b = np.zeros((size + 1, len(own))), np.zeros((size + 1, len(own)))
        a[0] = b[size] = 1
        for (s, e), piece in sorted(edges.items(), key=lambda x: x[0][1]):
            a[e] += a[s] * lifted[piece, 0]
        for (s, e), piece in sorted(edges.items(), key=lambda x: -x[0][1]):
            b[s] += lifted[piece, 0] * b[e]
        z = np.maximum(a[size], 1e-300)
        for (s, e), piece in edges.items():
            total += np.bincount(piece, weight * a[s] * lifted[piece, 0] * b[e] / z, pieces.size)
    return total


def fit(rows: DataFrame, model_file: str, rows_per_lang: int = 1500, rounds: int = 3) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities (pieces, languages) from rows of doc_id, text, lang.

    At most about ``rows_per_lang`` rows of each language teach: those whose
    hashed id, or text where the id is null, is below the share that this
    bound is of the language's rows.
    """
    sizes = rows.where("lang is not null").groupBy("lang").count().collect()
    hashed, picked = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text")), F.lit("fit")), F.lit(1_000_000)), F.lit(False)
    for r in sizes:  # a table of languages is as small as the model itself
        picked = picked | ((F.col("lang") == r["lang"]) & (hashed < min(1.0, rows_per_lang / r["count"]) * 1_000_000))
    picked = rows.where(picked & F.col("text").isNotNull())
    counts = saved(_word_counts(picked), "words")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    size = Pieces(model_file).size
    p = np.full((size, len(langs)), 1.0 / size)
    p[0], p[1] = 0, UNKNOWN
    for _ in range(rounds if langs else 0):
        now = p

        def run(batches, now=now):
            pieces, sums = Pieces(model_file), np.zeros((size, len(langs)))
            for b in batches:
                lang, word, n = b.column("lang").to_pylist(), b.column("word").to_pylist(), b.column("n").to_numpy()
                for k, name in enumerate(langs):
                    at = [i for i, x in enumerate(lang) if x == name]
                    if at:
                        sums[:, k] += expected_counts(pieces, [word[i] for i in at], n[at], now[:, k])
            trim()
            piece, k = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(k, pa.int32()), pa.array(sums[piece, k])], ["piece", "k", "n"])

        found = counts.mapInArrow(run, "piece int, k int, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).toPandas()
        p = np.full((size, len(langs)), SMOOTHING)
        p[found["piece"], found["k"]] += found["n"]
        p[:2] = 0
        p /= p.sum(axis=0)
        p[1] = UNKNOWN
    return langs, p


def predict(rows: DataFrame, model_file: str, langs: list[str], p: np.ndarray, text_col: str = "text") -> DataFrame:
    """rows with _lang_pred and _score besides."""
    given, names = p.astype(np.float64).tobytes(), [*rows.columns, "_lang_pred", "_score"]
    key = ("scorer", model_file, hashlib.sha256(given).digest())

    def run(batches):
        if langs:
            scorer = held(key, lambda: Scorer(model_file, np.frombuffer(given).reshape(-1, len(langs))))
        for b in slices(batches, TOGETHER):
            texts = b.column(text_col).to_pylist()
            if langs:
                logs = scorer.texts(texts)
                none = np.isnan(logs[:, 0])
                logs[none] = 0
                top = logs.argmax(axis=1)
                share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                best = ["und" if x else langs[t] for x, t in zip(none, top, strict=True)]
                sure = np.where(none, 0.0, share)
            else:
                best, sure = ["und"] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.string()), pa.array(sure, pa.float64())], names)
        trim()

    return rows.mapInArrow(run, StructType([*rows.schema, StructField("_lang_pred", StringType()), StructField("_score", DoubleType())]))


def held_out(doc_id) -> F.Column:
    """Rows that never teach: crc32 of the id as text leaves 2 by 4. Null ids teach."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify_rows(
    df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = 1500
) -> DataFrame:
    """The rows of df with _lang_pred and _score besides.

    Learns from rows that are not held out and have a lang. A text that is
    null or without letters gets ``und`` with score 0, and so does every text
    where no row teaches. The score is the probability of the language among
    those learned; at a tie the first by code point wins. Repeated rows get
    repeated answers; an empty table gives no rows. Columns that the table has
    under the two added names are replaced; other columns stay as they are.
    """
    df = df.drop("_lang_pred", "_score")
    doc_id = F.col(f"`{id_col}`")
    known = df.where(~held_out(doc_id)).select(
        doc_id.alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")
    )
    langs, p = fit(known, model_file, rows_per_lang)
    return predict(df, model_file, langs, p, text_col)


def identify(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of df, by ``identify_rows``."""
    slim = df.select(*dict.fromkeys(f"`{c}`" for c in (id_col, text_col, lang_col)))
    found = identify_rows(slim, model_file, id_col, text_col, lang_col, **options)
    doc_id = F.col(f"`{id_col}`")
    return found.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))
