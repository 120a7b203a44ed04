"""Alignment of two tokenizers' tokens over the bytes of whole texts.

Every byte of a text gets a label: whether a token of A ends there, one of B,
both or none. A regular expression scans the label string for spans up to
each byte where both end, and the labels that a span holds give the tokens of
its group. All pairs of A and B tokens of a group are links.

How many documents hold an id pair linked is counted over the whole corpus.
Documents are gathered to chunks with a dictionary of their distinct pairs, so
what is shuffled is a row for each pair of a chunk, not for each of a
document; the counts return to the chunks the same way.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from gridweave.llm.shared import held, only, parts, saved, trim
from gridweave.llm.tokens import Encoder

#: Bytes of texts that are aligned together; distinct pairs of documents that a chunk has, about.
TOGETHER, CHUNK_PAIRS = 1 << 21, 1 << 22
#: Links of a group up to which they are written out one by one; beyond, its distinct ids are paired with their numbers.
PLAIN_LINKS = 1 << 12
#: Keys in a row of a chunk's dictionary.
DICTIONARY_ROW = 1 << 16
#: A byte where a token of A ends, one of B, both.
A_END, B_END, BOTH = 1, 2, 3
_SPAN = re.compile(rb"[\x00-\x02]*\x03")
#: An id pair is one integer: B's id in the low bits.
B_BITS = 20


class LiteralEncoder(Encoder):
    """Ids of a byte-level BPE to which the special tokens' strings in a text are plain text."""

    def __init__(self, path: str):
        super().__init__(path, True, together=TOGETHER)
        from tokenizers import Tokenizer

        self._literal = Tokenizer.from_file(path)
        self._literal.encode_special_tokens = True

    def _together(self, texts: pa.Array) -> list[bytes]:
        if self._added is None:
            return super()._together(texts)
        special = pc.match_substring_regex(texts, self._added).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        for k, ids in zip(np.nonzero(~special)[0].tolist(), super()._together(texts.filter(pa.array(~special))), strict=True):
            out[k] = ids
        for k in np.nonzero(special)[0].tolist():
            out[k] = np.array(self._literal.encode(texts[k].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        return out


class PieceEncoder(Encoder):
    """Ids of a sentencepiece model. No piece but runs of blanks reaches over a blank, and none over a line end.

    So texts with single blanks are cut before each blank and beside each line
    end and looked up by units, as ``Encoder`` does; other texts are encoded whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self._model, self._ids, self._room, self._at_once = sentencepiece.SentencePieceProcessor(model_file=path), {}, 1 << 18, TOGETHER
        self._spaces, self._line = True, self._model.encode("\n")[-1]

    def _encode(self, units: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(units), 1000):
            raw = np.array(self._model.encode("\n" + "\n".join("" if u == "\n" else u for u in units[k : k + 1000]), num_threads=1), "<u4")
            ends = np.nonzero(raw == self._line)[0]
            out += [raw[a + 1 : b].tobytes() for a, b in zip(ends, [*ends[1:], len(raw)], strict=True)]
        line = np.array([self._line], "<u4").tobytes()
        return [line if u == "\n" else ids for u, ids in zip(units, out, strict=True)]

    def _together(self, texts: pa.Array) -> list[bytes]:
        spaced = pc.binary_join_element_wise(pa.scalar(""), texts, " ")
        plain = ~pc.match_substring_regex(spaced, "\\x00|  |▁").to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        self._gather(self._cut(spaced.filter(pa.array(plain))), np.nonzero(plain)[0], out)
        odd = np.nonzero(~plain)[0].tolist()
        for k, ids in zip(odd, self._model.encode([texts[k].as_py() for k in odd], num_threads=1) if odd else [], strict=True):
            out[k] = np.array(ids, "<u4").tobytes()
        return out


def byte_level_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level BPE file: printable bytes stand for themselves, the others for 256, 257, ... in their order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(printable)]
    byte = {**{chr(b): b for b in printable}, **{chr(256 + k): b for k, b in enumerate(other)}}
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    entries = {**whole["model"]["vocab"], **{t["content"]: t["id"] for t in whole.get("added_tokens", [])}}
    out = [b""] * (max(entries.values()) + 1)
    for name, i in entries.items():
        out[i] = bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode()
    return out


def piece_tokens(model) -> list[bytes]:
    """The bytes of each id of a sentencepiece model."""
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]


def token_groups(labels: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, tokens of A and tokens of B of each group: the spans of a label string up to each byte where both end."""
    spans = _SPAN.findall(labels)
    kinds = set(spans)
    of_a, of_b = ({s: s.count(bytes([end])) + 1 for s in kinds} for end in (A_END, B_END))
    return tuple(np.fromiter(map(f, spans), np.int64, len(spans)) for f in (len, of_a.__getitem__, of_b.__getitem__))


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def links(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """document, id pair, number of the links of groups with p tokens of A and q of B each, ordered by document and pair."""
    from_a, from_b, many = _starts(p), _starts(q), p * q
    small, weights = np.nonzero(many <= PLAIN_LINKS)[0], []
    n = many[small]
    within = np.arange(n.sum()) - np.repeat(_starts(n), n)
    wide = np.repeat(q[small], n)
    left = np.repeat(from_a[small], n) + within // wide
    right = np.repeat(from_b[small], n) + within % wide
    docs, pairs = [np.repeat(doc[small], n)], [(a[left] << B_BITS) | b[right]]
    weights.append(np.ones(len(within), np.int64))
    for g in np.nonzero(many > PLAIN_LINKS)[0].tolist():
        ours, n_ours = np.unique(a[from_a[g] : from_a[g] + p[g]], return_counts=True)
        theirs, n_theirs = np.unique(b[from_b[g] : from_b[g] + q[g]], return_counts=True)
        pairs.append(((ours << B_BITS)[:, None] | theirs).ravel())
        weights.append((n_ours[:, None] * n_theirs).ravel())
        docs.append(np.full(len(pairs[-1]), doc[g]))
    docs, pairs, weights = map(np.concatenate, (docs, pairs, weights))
    if not len(pairs):
        return docs, pairs, weights
    # Documents stand in order, so a stable sort by pair within each is one sort of both together.
    order = np.lexsort((pairs, docs))
    docs, pairs = docs[order], pairs[order]
    first = np.nonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (pairs[1:] != pairs[:-1]))))[0]
    return docs[first], pairs[first], np.add.reduceat(weights[order], first)


class Aligner:
    """Both tokenizers of a Python worker."""

    def __init__(self, byte_level: str, piece_model: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._a, self._b = LiteralEncoder(byte_level), PieceEncoder(piece_model)
        self._bytes = byte_level_tokens(byte_level), piece_tokens(self._b._model)
        self._sizes = [np.array([len(x) for x in t], np.int64) for t in self._bytes]
        n_a, n_b = map(len, self._bytes)
        #: Strings of A ids inside a group and at its end, then those of B ids.
        self._names = [f"{i}{end}" for n, ends in ((n_a, ",|"), (n_b, ",;")) for end in ends for i in range(n)]

    def __call__(self, texts: pa.Array):
        """For each text (n_a, n_b, n_groups, n_links, digest, pairs, numbers)."""
        texts = texts.cast(pa.string()).fill_null("")
        raw = [b" " + t.as_buffer().to_pybytes() if len(t.as_buffer() or b"") else b"" for t in texts]
        spaced = pc.binary_join_element_wise(pa.scalar(""), texts, " ")
        found = [[np.frombuffer(x, "<u4").astype(np.int64) for x in ids] for ids in (self._a(spaced), self._b(texts))]
        whole = [
            k for k, want in enumerate(raw)
            if want and all(b"".join(map(names.__getitem__, ids[k].tolist())) == want for names, ids in zip(self._bytes, found, strict=True))
        ]
        out = [(0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64))] * len(raw)
        if not whole:
            return out
        n_a, n_b = (np.array([len(ids[k]) for k in whole]) for ids in found)
        a, b = (np.concatenate([ids[k] for k in whole]) for ids in found)
        labels = np.zeros(sum(len(raw[k]) for k in whole), np.uint8)
        for ids, sizes, end in ((a, self._sizes[0], A_END), (b, self._sizes[1], B_END)):
            labels[np.cumsum(sizes[ids]) - 1] |= end
        length, p, q = token_groups(labels.tobytes())
        ends = np.cumsum([len(raw[k]) for k in whole])
        doc = np.searchsorted(ends, np.cumsum(length))
        digests = self._digests(a, b, p, q, n_a + n_b)
        groups = np.bincount(doc, minlength=len(whole))
        of, pairs, numbers = links(a, b, p, q, doc)
        n_links, cuts = np.add.reduceat(p * q, _starts(groups)), np.searchsorted(of, np.arange(len(whole) + 1))
        for j, k in enumerate(whole):
            part = slice(cuts[j], cuts[j + 1])
            out[k] = (int(n_a[j]), int(n_b[j]), int(groups[j]), int(n_links[j]), digests[j], pairs[part], numbers[part])
        return out

    def _digests(self, a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, tokens: np.ndarray) -> list[str]:
        """sha256 of each document's groups, written ``a1,a2|b1;a3|b2``."""
        code = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[np.cumsum(p) - 1], last_b[np.cumsum(q) - 1] = True, True
        sizes = [len(t) for t in self._bytes]
        code[np.arange(len(a)) + np.repeat(_starts(q), p)] = a + sizes[0] * last_a
        code[np.arange(len(b)) + np.repeat(np.cumsum(p), q)] = b + sizes[1] * last_b + 2 * sizes[0]
        ends, out = np.cumsum(tokens), []
        for e, n in zip(ends.tolist(), tokens.tolist(), strict=True):
            out.append(hashlib.sha256("".join(map(self._names.__getitem__, code[e - n : e].tolist()))[:-1].encode()).hexdigest())
        return out


_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long"


def _aligned(docs: DataFrame, byte_level: str, piece_model: str, chunk_pairs: int) -> DataFrame:
    """A row for each document with its places in the chunk's dictionary, as differences, and the numbers of its links there; and the dictionaries' rows."""
    schema = pa.schema(
        [("chunk", pa.int64()), *((n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("places", pa.binary()), ("numbers", pa.binary())]
        + [("base", pa.int32()), ("pairs", pa.list_(pa.int64())), ("holders", pa.list_(pa.int32()))]
    )

    def chunk_rows(chunk: int, rows: list) -> Iterator[pa.RecordBatch]:
        pairs, holders = np.unique(np.concatenate([r[6] for r in rows]), return_counts=True)
        for k in range(0, len(rows), 256):
            some, out = rows[k : k + 256], {n: [] for n in schema.names}
            for who, n_a, n_b, n_groups, n_links, digest, own, numbers in some:
                steps = np.diff(np.searchsorted(pairs, own), prepend=0)
                kind = "<u4" if numbers.max(initial=0) < 1 << 32 else "<u8"
                row = (chunk, who, n_a, n_b, n_groups, n_links, digest, steps.astype("<u4").tobytes(), numbers.astype(kind).tobytes(), None, None, None)
                for name, value in zip(schema.names, row, strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema)
        for k in range(0, len(pairs), DICTIONARY_ROW):
            part = {n: pa.nulls(1, schema.field(n).type) for n in schema.names}
            part |= {"chunk": pa.array([chunk], pa.int64()), "base": pa.array([k], pa.int32())}
            for name, values, kind in (("pairs", pairs, pa.int64()), ("holders", holders, pa.int32())):
                cut = pa.array(values[k : k + DICTIONARY_ROW], kind)
                part[name] = pa.ListArray.from_arrays(pa.array([0, len(cut)], pa.int32()), cut)
            yield pa.RecordBatch.from_pydict(part, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = held(("align", byte_level, piece_model), lambda: Aligner(byte_level, piece_model))
        chunk, size, rows = None, 0, []
        for b in parts(batches, "text", TOGETHER):
            if chunk is None:
                chunk = b.column("task")[0].as_py() << 32
            for who, found in zip(b.column("doc_id").to_pylist(), align(b.column("text")), strict=True):
                rows.append((who, *found))
                size += len(found[5])
                if size >= chunk_pairs:
                    yield from chunk_rows(chunk, rows)
                    chunk, size, rows = chunk + 1, 0, []
        if rows:
            yield from chunk_rows(chunk, rows)
        rows.clear()
        trim()

    dealt = docs.withColumn("task", F.spark_partition_id().cast("long"))
    return dealt.mapInArrow(run, f"chunk long, {_DOC}, groups_sha256 string, places binary, numbers binary, base int, pairs array<long>, holders array<int>")


def _summed(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """n_best and count_sum of a chunk's documents."""
    place = counts.column("place").to_numpy()
    size = int(place.max(initial=-1)) + 1
    n, best = np.zeros(size, np.int64), np.zeros(size, bool)
    n[place], best[place] = counts.column("n").to_numpy(), counts.column("best").to_numpy(zero_copy_only=False)
    n_best, count_sum = [], []
    for steps, numbers in zip(docs.column("places"), docs.column("numbers"), strict=True):
        at = np.cumsum(np.frombuffer(steps.as_buffer(), "<u4"), dtype=np.int64)
        many = np.frombuffer(numbers.as_buffer(), "<u4" if len(numbers.as_buffer()) == 4 * len(at) else "<u8").astype(np.int64)
        n_best.append(int(many[best[at]].sum()))
        count_sum.append(int((many * n[at]).sum()))
    kept = docs.drop_columns(["chunk", "places", "numbers"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))


def aligned(df: DataFrame, byte_level: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text", chunk_pairs: int = CHUNK_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of each row.

    A is the byte-level BPE file on a blank and the text, B the sentencepiece
    model on the text, which adds the blank. n_best counts the links whose
    count is the highest that their A id has in the corpus, ties included;
    count_sum adds up the counts of all links. Null and empty texts, and texts
    that either tokenizer doesn't give back byte by byte, have no tokens: zeros
    and an empty digest. Null ids come back as null; each of several equal
    rows is a document of its own in all counts. A long group without a common
    end is paired by its distinct ids. An empty table gives no rows.
    """
    docs = only(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    found = saved(_aligned(docs, byte_level, piece_model, chunk_pairs), "aligned")
    dictionary = found.where("pairs is not null").select("chunk", "base", F.posexplode(F.arrays_zip("pairs", "holders")).alias("at", "x"))
    dictionary = dictionary.select("chunk", (F.col("base") + F.col("at")).alias("place"), F.col("x.pairs").alias("pair"), F.col("x.holders").alias("holders"))
    counts = dictionary.groupBy("pair").agg(F.sum("holders").alias("n"))
    of_a = W.partitionBy(F.shiftright("pair", B_BITS))  # as many rows at most as B has ids
    counts = counts.withColumn("best", F.col("n") == F.max("n").over(of_a))
    known = dictionary.join(counts, "pair").select(F.col("chunk").alias("of"), "place", "n", "best")
    rows = found.where("pairs is null").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "numbers")
    return rows.groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(_summed, f"{_DOC}, groups_sha256 string, n_best long, count_sum long")
