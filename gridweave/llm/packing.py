"""Best-fit packing of tokenized documents into sequences of a fixed length.

Documents are tokenized once and their pieces written as a small table
without texts. Pieces are dealt evenly to groups, and each group is packed by
itself: bounded-space online best fit, longest piece first. A group has about
as many tokens as its open bins can hold, so bins rarely close before the
short pieces come; what groups can lose is a last sequence each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridweave.llm.shared import only, parts, saved, trim
from gridweave.llm.tokens import TOGETHER, Encoder

#: Bins that a group has open at once, and the share of them that its tokens fill on average.
OPEN_BINS, FILL = 4096, 0.85
#: Pieces of a group, about, where these are so short that tokens would allow more.
GROUP_PIECES = 500_000


class BestFit:
    """Bounded-space online best fit.

    Open bins are kept by free space, with a bit set for each space that some
    bin has: the lowest bit at or above a length is the best fit. If a new bin
    is needed and ``limit`` are open, the fullest closes first.
    """

    def __init__(self, capacity: int, limit: int = OPEN_BINS):
        self.capacity, self.limit = capacity, limit
        self.bins, self.open, self._free, self._bits = 0, 0, {}, 0

    def _take(self, space: int) -> int:
        left = self._free[space]
        found = left.pop()
        if not left:
            self._bits &= ~(1 << space)
        return found

    def place(self, length: int) -> tuple[int, int]:
        """The bin of a piece of this length, and its place there."""
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece has 1 to {self.capacity} tokens, not {length}")
        fits = self._bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            found = self._take(space)
        else:
            if self.open == self.limit:
                self._take((self._bits & -self._bits).bit_length() - 1)
                self.open -= 1
            space, found = self.capacity, self.bins
            self.bins += 1
            self.open += 1
        left = space - length
        if left:
            self._free.setdefault(left, []).append(found)
            self._bits |= 1 << left
        else:
            self.open -= 1
        return found, self.capacity - space


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """piece, start, length, crc32 of the pieces of a document's ids."""
    step = 4 * capacity
    for k in range(0, len(ids), step):
        part = ids[k : k + step]
        yield k // step, k // 4, len(part) // 4, zlib.crc32(part)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of doc_id, text."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of(tokenizer, False)
        for b in parts(batches, "text", TOGETHER):
            who, out = [], []
            for i, ids in enumerate(encode(b.column("text"))):
                found = list(cut(ids + end, capacity))
                out += found
                who += [i] * len(found)
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(who, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.int64()] * 3), strict=True))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        trim()

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _packed(capacity: int, limit: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        fit, base = BestFit(capacity, limit), int(t.column("pack")[0].as_py()) << 32
        places = [fit.place(n) for n in t.column("length").to_pylist()]
        return t.drop_columns(["pack"]).append_column("sequence_id", pa.array([base + p for p, _ in places], pa.int64())).append_column(
            "offset", pa.array([o for _, o in places], pa.int64())
        )

    return run


def best_fit_packing(
    df: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 4096,
    end_id: int = 1,
    open_bins: int = OPEN_BINS,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece.

    A document is its text's ids (word BPE file ``tokenizer``) and ``end_id``;
    only documents longer than ``capacity`` are cut. Null and empty texts are
    the end id alone. Null ids come back as null; repeated rows are packed as
    often as they come, each with its own places. Of pieces of one length,
    which are alike to best fit, the smaller id goes first. An empty table
    gives no rows.
    """
    docs = only(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    found = saved(pieces(docs, tokenizer, capacity, end_id), "pieces")
    rows, total = found.agg(F.count("*"), F.sum("length")).first()
    groups = int(max((total or 0) / (capacity * open_bins * FILL), rows / GROUP_PIECES)) + 1
    dealt = found.withColumn("pack", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("pack").applyInArrow(_packed(capacity, open_bins), schema)
