"""Token ids in a binary format of shuffled bit or byte planes.

A block holds a fixed number of ids. It is transposed: plane k holds bit k
(or byte k) of every id, so that bits that change rarely stand together, and
each plane is compressed with zstandard. A stretch is some whole documents'
blocks with their chunk index (where each plane of each block starts) and
its documents' lengths, so it can be read alone, and any one block of it
without the others.

Stretches are rows of a Parquet table: Spark's commit protocol then covers
lost executors, and the table can stand in any store that Spark writes to.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridweave.llm.shared import only, parts
from gridweave.llm.tokens import KEPT_UNITS, TOGETHER, Encoder

MAGIC = b"BPS1"
#: Ids in a block, and ids in a stretch, about.
BLOCK_IDS, STRETCH_IDS = 1 << 15, 1 << 20
_HEAD = struct.Struct("<4sBxxxIQ")


def to_planes(ids: np.ndarray, bits: bool) -> np.ndarray:
    """The planes of ids, one a row: 32 of bits or 4 of bytes."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return np.ascontiguousarray(octets.T)
    return np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1, bitorder="little")


def from_planes(planes: np.ndarray, n: int, bits: bool) -> np.ndarray:
    if not bits:
        return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)
    flat = np.unpackbits(planes, axis=1, count=n, bitorder="little").T
    return np.packbits(flat, axis=1, bitorder="little").copy().view("<u4").reshape(-1)


def pack(ids: np.ndarray, block: int = BLOCK_IDS, bits: bool = False, level: int = 3) -> bytes:
    """Head, chunk index (uint64 ends of all planes of all blocks), planes."""
    squeeze, parts = zstandard.ZstdCompressor(level=level), []
    for k in range(0, len(ids), block):
        parts += [squeeze.compress(p.tobytes()) for p in to_planes(ids[k : k + block], bits)]
    ends = np.cumsum([len(p) for p in parts], dtype="<u8") if parts else np.empty(0, "<u8")
    return _HEAD.pack(MAGIC, bits, block, len(ids)) + ends.tobytes() + b"".join(parts)


def unpack(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """All ids, or those of the blocks first up to but without last."""
    magic, bits, block, n = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("these are not packed ids")
    planes, count = (32 if bits else 4), -(-n // block)
    ends = np.frombuffer(data, "<u8", count * planes, _HEAD.size)
    body, expand = _HEAD.size + 8 * count * planes, zstandard.ZstdDecompressor()
    starts, out = np.concatenate(([0], ends[:-1])).astype(np.int64), []
    for k in range(first, count if last is None else min(last, count)):
        size = min(block, n - k * block)
        rows = [
            np.frombuffer(expand.decompress(data[body + int(starts[j]) : body + int(ends[j])]), np.uint8)
            for j in range(k * planes, (k + 1) * planes)
        ]
        out.append(from_planes(np.stack(rows), size, bool(bits)))
    return np.concatenate(out) if out else np.empty(0, "<u4")


def write_ids(
    df: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    bits: bool = False,
    block: int = BLOCK_IDS,
    stretch: int = STRETCH_IDS,
) -> None:
    """Writes the ids of all texts (byte-level BPE file ``tokenizer``), each with ``end_id``, in ascending id order.

    Null and empty texts are the end id alone; null ids stand first; rows with
    one id stand by their texts. Documents are never cut: a very long one has
    a stretch of its own. An empty table gives an empty file.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, start, held, ids, size = Encoder.of(tokenizer, True, 2 * KEPT_UNITS, 4 * TOGETHER), 0, [], [], 0
        shard = None

        def out() -> pa.RecordBatch:
            n = [len(x) // 4 for x in ids]
            data = pack(np.frombuffer(b"".join(ids), "<u4"), block, bits)
            return pa.RecordBatch.from_pydict(
                {"shard": [shard], "start": [start], "n_ids": [sum(n)], "doc_ids": [held], "lengths": [n], "data": [data]},
                pa.schema([("shard", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("data", pa.binary())]),
            )

        for b in parts(batches, "text", 4 * TOGETHER):
            for who, where, found in zip(b.column("doc_id").to_pylist(), b.column("shard").to_pylist(), encode(b.column("text")), strict=True):
                shard = where
                held.append(who)
                ids.append(found + end)
                size += len(ids[-1]) // 4
                if size >= stretch:
                    yield out()
                    start, held, ids, size = start + size, [], [], 0
        if held:
            yield out()

    docs = only(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    # Rows of one id, null ids above all, are dealt by the beginnings of their texts, which their order follows.
    place = F.col("doc_id").asc_nulls_first()
    dealt = docs.repartitionByRange(place, F.substring("text", 1, 32)).sortWithinPartitions(place, "text")
    dealt.select("doc_id", "text", F.spark_partition_id().alias("shard")).mapInArrow(
        run, "shard int, start long, n_ids long, doc_ids array<long>, lengths array<long>, data binary"
    ).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents of a file, decoded from its planes.

    start counts the ids of all documents before. What each shard holds comes
    from the index columns; only those sums, one a shard, pass the driver.
    """
    whole = spark.read.schema("shard int, start long, n_ids long, doc_ids array<long>, lengths array<long>, data binary").parquet(path)
    sums = whole.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    before = dict(zip([r["shard"] for r in sums], np.cumsum([0, *(r["n"] for r in sums)]).tolist()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                ids, n = unpack(row.column("data")[0].as_py()), row.column("lengths").flatten().to_numpy()
                ends = np.cumsum(n)
                raw, base = ids.tobytes(), before[row.column("shard")[0].as_py()] + row.column("start")[0].as_py()
                crc = [zlib.crc32(raw[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [row.column("doc_ids").flatten(), pa.array(base + ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return whole.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
