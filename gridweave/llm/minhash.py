"""MinHash near-dedup with HyperMinHash sketches.

1. One pass over the texts makes a sketch of each: the size and a digest of
   its shingle set and 128 registers of 16 bits.
2. Equal sets form a class, and the least id of a class stands for it, so
   exact copies are never compared.
3. Bands of three registers are hashed to buckets. Every member of a bucket
   is held against the bucket's least id (a star, not all pairs). What the
   collision-corrected estimate can't rule out is verified on full sets.
   Small sets, for which bands are unsure, have their first few hashes in
   order as buckets too: sets that are similar enough share one of these.
4. Connected components of those links leave few buckets with members of
   several components. Such buckets are cut into blocks of bounded size, in
   which the pairs across components are estimated and then verified on full
   sets. A block returns at most one link for each member, so no group of
   copies is expanded into its pairs, and no candidate is left out.
5. Components over both kinds of links give the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gridweave.llm import sketch as K
from gridweave.llm.components import components
from gridweave.llm.shared import only, parts, release, saved, slices, trim

#: Sets of fewer shingles reach a similarity of 0.75 only if they are equal.
LEAST_SET = 3
#: Members, and shingles of all members, that a block may hold of one side.
BLOCK_MEMBERS, BLOCK_SHINGLES = 4096, 1_000_000
#: Pairs that are estimated together.
PAIRS = 1 << 15


def _sketched(docs: DataFrame, width: int, percent: int) -> DataFrame:
    def run(batches):
        release()
        for b in parts(batches, "text", rows=512):
            sets = [K.shingles(t, width) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([K.set_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([K.registers(s).tobytes() if len(s) >= LEAST_SET else None for s in sets], pa.binary()),
                    pa.array([K.prefix_keys(s, percent) if len(s) >= LEAST_SET else [] for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "digest", "regs", "prefix"],
            )
        trim()

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, regs binary, prefix array<long>")


def _banded(classes: DataFrame) -> DataFrame:
    def run(batches):
        for b in slices(batches):
            keys, who = [], []
            for i, (r, prefix) in enumerate(zip(b.column("regs").to_pylist(), b.column("prefix").to_pylist(), strict=True)):
                own = K.band_keys(np.frombuffer(r, np.uint16)) + prefix
                keys += own
                who += [i] * len(own)
            at = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), b.column("rep").take(at), b.column("n").take(at)], ["key", "rep", "n"]
            )

    return classes.where(F.col("n") >= LEAST_SET).select("rep", "n", "regs", "prefix").mapInArrow(run, "key long, rep long, n long")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """rep, hashes (sorted, 8 bytes each): the full set of each wanted class, from the text of its representative.

    An id that has several texts keeps the one whose set its class is of.
    """

    def run(batches):
        for b in parts(batches, "text", rows=512):
            sets = [K.shingles(t, width) for t in b.column("text").to_pylist()]
            own = [K.set_digest(s) == d for s, d in zip(sets, b.column("digest").to_pylist(), strict=True)]
            hashes = pa.array([s.tobytes() if o else None for s, o in zip(sets, own, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("rep"), hashes], ["rep", "hashes"]).filter(pa.array(own, pa.bool_()))
        trim()

    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(wanted, "rep")
    found = texts.select("rep", "digest", "text").mapInArrow(run, "rep long, hashes binary")
    return found.dropDuplicates(["rep"])


def _arrays(column: pa.ChunkedArray | pa.Array, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def _estimated(pairs: DataFrame, least: float) -> DataFrame:
    """The pairs that their registers can't rule out."""

    def run(batches):
        for b in slices(batches, 2048):
            a, c = (np.stack(_arrays(b.column(x), np.uint16)) for x in ("regs_a", "regs_b"))
            n, m = (b.column(x).to_numpy(zero_copy_only=False) for x in ("n_a", "n_b"))
            keep = pa.array(K.may_link(a, c, n, m, least))
            yield b.select(["a", "b"]).filter(keep)
        trim()

    return pairs.mapInArrow(run, "a long, b long")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def _linked(common, n, m, percent: int):
    return 100 * common >= percent * (n + m - common)


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    def run(batches):
        for b in parts(batches, "set_a"):
            left, right = (_arrays(b.column(x), np.uint64) for x in ("set_a", "set_b"))
            keep = [_linked(_common(x, y), len(x), len(y), percent) for x, y in zip(left, right, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        trim()

    return pairs.mapInArrow(run, "a long, b long")


def _pairs_of(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of rows of one group each, for groups of consecutive rows that end (exclusive) at the given places."""
    sizes = np.diff(np.concatenate(([0], ends)))
    left = np.repeat(ends, sizes) - np.arange(len(np.repeat(ends, sizes))) - 1  # rows of the group after each row
    i = np.repeat(np.arange(len(left)), left)
    j = np.arange(len(i)) - np.repeat(np.cumsum(left) - left, left) + i + 1
    return i, j


def _rounds(block: np.ndarray, shingles: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Stretches of whole blocks with few pairs, and few shingles if those of the rows are given, together, or of one block."""
    ends = np.append(np.nonzero(block[1:] != block[:-1])[0] + 1, len(block))
    sizes = np.diff(np.concatenate(([0], ends)))
    share = sizes * (sizes - 1) // 2 / PAIRS
    if shingles is not None:
        share = np.maximum(share, np.add.reduceat(shingles, ends - sizes) / BLOCK_SHINGLES)
    start, end, held = 0, 0, 0.0
    for e, p in zip(ends.tolist(), share.tolist(), strict=True):
        if end > start and held + p > 1:
            yield start, end
            start, held = end, 0.0
        end, held = e, held + p
    if start < len(block):
        yield start, len(block)


def _held_together(frames, columns: list[str]) -> Iterator[pa.Table]:
    """Arrow batches of rows sorted by block as tables of whole blocks."""
    rest = None
    for b in frames:
        t = pa.Table.from_batches([b.select(["block", *columns])])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        block = t.column("block").to_numpy()
        cut = int(np.nonzero(block != block[-1])[0][-1]) + 1 if block[0] != block[-1] else 0
        rest = t.slice(cut)
        if cut:
            yield t.slice(0, cut)
    if rest is not None and rest.num_rows:
        yield rest


def _candidates(block: np.ndarray, regs: np.ndarray, n: np.ndarray, comp: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one block and different components that may link."""
    ends = np.append(np.nonzero(block[1:] != block[:-1])[0] + 1, len(block))
    if len(ends) == 1 and len(block) > 512:
        for i in range(len(block) - 1):
            j = np.nonzero((comp[i + 1 :] != comp[i]) & (np.minimum(n[i + 1 :], n[i]) >= least * np.maximum(n[i + 1 :], n[i])))[0] + i + 1
            if len(j):
                j = j[K.may_link(np.broadcast_to(regs[i], (len(j), K.BUCKETS)), regs[j], np.full(len(j), n[i]), n[j], least)]
                yield np.full(len(j), i), j
        return
    i, j = _pairs_of(ends)
    keep = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]))
    i, j = i[keep], j[keep]
    for k in range(0, len(i), PAIRS):
        a, b = i[k : k + PAIRS], j[k : k + PAIRS]
        good = K.may_link(regs[a], regs[b], n[a], n[b], least)
        yield a[good], b[good]


def _possible(least: float):
    """Of blocks, the members with a possible partner in another component."""

    def run(frames):
        for whole in _held_together(frames, ["rep", "n", "comp", "regs"]):
            for a, z in _rounds(whole.column("block").to_numpy()):
                t = whole.slice(a, z - a)
                regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(-1, K.BUCKETS)
                block, n, comp = (t.column(c).to_numpy() for c in ("block", "n", "comp"))
                keep = np.zeros(len(n), bool)
                for i, j in _candidates(block, regs, n, comp, least):
                    keep[i] = True
                    keep[j] = True
                yield from t.select(["block", "rep", "comp"]).filter(pa.array(keep)).to_batches()
        trim()

    return run


def _block_links(least: float, percent: int):
    """Links of blocks that join different components, at most one for each member."""

    def run(frames):
        for whole in _held_together(frames, ["rep", "comp", "hashes"]):
            shingles = pc.binary_length(whole.column("hashes")).to_numpy() // 8
            for s, z in _rounds(whole.column("block").to_numpy(), shingles):
                t = whole.slice(s, z - s)
                sets = _arrays(t.column("hashes"), np.uint64)
                block, rep, comp = (t.column(c).to_numpy() for c in ("block", "rep", "comp"))
                regs, n, a, b = np.stack([K.registers(x) for x in sets]), np.array([len(x) for x in sets]), [], []
                words, flat = np.unique(np.concatenate(sets), return_inverse=True)
                starts, mark = np.cumsum(n) - n, np.zeros(len(words), bool)
                # A component is known by its block too: links of one block say nothing about another's.
                label = np.unique(np.column_stack((block, comp)), axis=0, return_inverse=True)[1].reshape(-1)
                for left, right in _candidates(block, regs, n, comp, least):
                    for i in np.unique(left).tolist():
                        j = right[left == i] if left[0] != left[-1] else right
                        j = j[label[j] != label[i]]
                        if not len(j):
                            continue
                        own = flat[starts[i] : starts[i] + n[i]]
                        mark[own] = True
                        upto = np.cumsum(n[j])
                        at = np.repeat(starts[j] - upto + n[j], n[j]) + np.arange(upto[-1])
                        common = np.add.reduceat(mark[flat[at]].astype(np.int64), upto - n[j])
                        mark[own] = False
                        for x in j[_linked(common, n[i], n[j], percent)].tolist():
                            if label[x] != label[i]:
                                a.append(rep[i])
                                b.append(rep[x])
                                label[label == label[x]] = label[i]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        trim()

    return run


def _by_block(rows: DataFrame, run, schema: str) -> DataFrame:
    """run over rows that stand in order of their blocks, each block whole in one task."""
    return rows.repartition("block").sortWithinPartitions("block", "rep").mapInArrow(run, schema)


def _blocked(rows: DataFrame) -> DataFrame:
    """key, rep, n, comp with the blocks of buckets that hold several components.

    Those of the bucket's least component are class 0, the others class 1;
    each class is cut into chunks. A block is a chunk of either class, or two
    of class 1: class 0 is one component and needs no pairs of its own.
    """
    buckets = (
        rows.groupBy("key")
        .agg(F.min("comp").alias("home"), F.max("comp").alias("other"), F.count("*").alias("size"), F.sum("n").alias("total"))
        .where("home <> other")
        .select(
            "key", "home", F.greatest(F.ceil(F.col("size") / BLOCK_MEMBERS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("chunks")
        )
    )
    x = rows.join(buckets, "key").withColumn("h", F.expr("int(pmod(xxhash64(rep), chunks))"))
    each = "transform(sequence(0, chunks - 1), j -> {})"
    blocks = F.expr(
        "case when chunks = 1 then array('all') when comp = home then "
        + each.format("concat_ws('x', 'h', h, j)")
        + " else concat("
        + each.format("concat_ws('x', 'h', j, h)")
        + ", "
        + each.format("concat_ws('x', 'o', least(h, j), greatest(h, j))")
        + ") end"
    )
    return x.select("rep", "n", "comp", "key", F.explode(blocks).alias("part")).select(
        "rep", "n", "comp", F.xxhash64("key", "part").alias("block")
    )


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.75, width: int = 5
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of df.

    Texts are linked if their sets of ``width``-word shingles have a Jaccard
    similarity of ``least`` or more, confirmed on full sets. component_id is
    the least id that links reach; the row whose id it is is kept.

    A null or wordless text has an empty set and links with nothing. Rows with
    a null id come back with a null component and are kept, unlinked. Rows
    that share an id count as one document with several texts: each text's
    links are the document's. Ties can't arise, as ids order everything. An
    empty table gives an empty result. Only the two named columns are read.
    """
    percent = round(100 * least)
    docs = only(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    all_docs = saved(_sketched(docs, width, percent), "sketch")
    named = all_docs.where("doc_id is not null")
    classes = saved(
        named.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.first("prefix").alias("prefix")),
        "classes",
    )
    own = classes.select("rep", "digest")

    bands = saved(_banded(classes), "bands")
    buckets = bands.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("leader")).where("size > 1")
    members = saved(bands.join(buckets.select("key", "leader"), "key"), "members")
    regs = classes.where(F.col("n") >= LEAST_SET).select("rep", "n", "regs")

    def side(x: str, columns: list[str]) -> list:
        return [F.col("rep").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns)]

    star = members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    both = star.join(regs.select(*side("b", ["n", "regs"])), "b").join(regs.select(*side("a", ["n", "regs"])), "a")
    pairs = saved(_estimated(both, least), "pairs")

    one_text = lambda wanted: _sets(docs, wanted.join(own, "rep"), width)
    sets = saved(one_text(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()), "sets")
    side_set = lambda x: sets.select(F.col("rep").alias(x), F.col("hashes").alias(f"set_{x}"))
    links = saved(_verified(pairs.join(side_set("b"), "b").join(side_set("a"), "a"), percent), "links")

    # Rows that share an id connect the classes of their texts.
    several = named.where("n > 0").groupBy("doc_id").agg(F.min("digest").alias("d0"), F.max("digest").alias("d1")).where("d0 <> d1")
    shared_id = (
        named.where("n > 0").join(several.select("doc_id"), "doc_id").join(own, "digest")
        .select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    )
    first = saved(components(links.union(shared_id), "a", "b"), "components")

    # Pairs with a bucket's leader have been held against each other above.
    placed = members.where("rep <> leader").select("key", "rep", "n").join(first.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.select("key", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    blocks = _blocked(saved(placed, "placed"))
    possible = saved(
        _by_block(blocks.join(regs.select("rep", "regs"), "rep").select("block", "rep", "n", "comp", "regs"), _possible(least), "block long, rep long, comp long"),
        "possible",
    )
    late_sets = one_text(possible.select("rep").distinct())
    late = saved(
        _by_block(possible.join(late_sets, "rep").select("block", "rep", "comp", "hashes"), _block_links(least, percent), "a long, b long"),
        "links",
    )

    reach = first.select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = components(reach.union(late), "a", "b")
    class_of = own.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("component")
    )
    found = all_docs.join(class_of, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.75, width: int = 5) -> DataFrame:
    """The rows of df that stay when one document of each group does.

    That is the one with the least id; rows that share this id all stay. Null
    ids and texts that link with nothing stay too.
    """
    gone = near_duplicates(df, id_col, text_col, least, width).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return df.join(gone, F.col(f"`{id_col}`").cast("long") == F.col("_gone"), "left_anti")
