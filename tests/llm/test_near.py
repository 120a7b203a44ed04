import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from gridweave.llm import minhash as M, sketch as K
from gridweave.llm.components import components
from gridweave.llm.minhash import deduplicated, near_duplicates


def brute(rows, least=75):
    sets, nodes = [], {}
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append((r[0], {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
        nodes[r[0]] = r[0]

    def find(x):
        while nodes[x] != x:
            x = nodes[x]
        return x

    for (i, a), (j, b) in itertools.combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if 100 * len(a & b) >= least * len(a | b):
            x, y = sorted((find(i), find(j)))
            nodes[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def test_components_are_those_of_brute_force(spark, corpus, docs):
    got = near_duplicates(docs)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(corpus)


def test_large_group_of_chained_near_copies(spark):
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(150):  # each differs from the next by one word, the ends have little in common
        rows.append((k, " ".join(words[:k % 50] + ["x"] + words[k % 50 :] + [f"t{k // 10}"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect()), key=str) == brute(rows)


def test_one_of_each_group_stays(spark, docs, corpus):
    kept = {(r.doc_id, r.text) for r in deduplicated(docs).collect()}
    least = {i: c for i, _, c in brute(corpus)}
    assert {i for i, _ in kept} == {i for i, c in least.items() if i == c or i is None}
    assert deduplicated(docs).columns == docs.columns


def test_empty_table(empty):
    assert near_duplicates(empty).count() == 0


def test_registers_estimate_similarity():
    a = K.shingles(" ".join(map(str, range(3000))))
    b = K.shingles(" ".join(map(str, range(600, 3600))))
    found, full = K.estimated(K.registers(a)[None], K.registers(b)[None], [len(a)], [len(b)])
    assert abs(found[0] - 2396 / 3596) < 0.2 and full[0] == K.BUCKETS
    assert K.may_link(K.registers(a)[None], K.registers(a)[None], [len(a)], [len(a)])[0]


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 140)}}


def test_small_sets_that_differ_by_an_end_word(spark):
    rows = []
    for n in range(6, 24):
        for k in range(12):
            text = " ".join(f"v{n}x{k}y{j}" for j in range(n))
            rows += [(len(rows), text), (len(rows) + 1, text + " more") if k % 2 else (len(rows) + 1, "more " + text)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)
    assert [c for i, _, c in got if rows[i][1].split()[-1] == "more" and len(rows[i][1].split()) == 8] and any(n == 4 and c != i for i, n, c in got)


def test_small_sets_always_share_a_key():
    rng = random.Random(1)
    for _ in range(3000):
        n = rng.randint(3, 20)
        a = sorted(rng.getrandbits(64) for _ in range(n))
        b = sorted({rng.getrandbits(64) if rng.random() < 0.1 else x for x in a} | {rng.getrandbits(64) for _ in range(rng.randint(0, 1))})
        if min(len(a), len(b)) < K.SMALL_SET and 100 * len(set(a) & set(b)) >= 75 * len(set(a) | set(b)):
            keys = [set(K.prefix_keys(np.array(x, np.uint64), 75)) for x in (a, b)]
            assert keys[0] & keys[1]


def test_blocks_that_are_cut(spark, monkeypatch):
    from gridweave.llm import minhash as M

    monkeypatch.setattr(M, "BLOCK_MEMBERS", 8)
    monkeypatch.setattr(M, "PAIRS", 50)
    rng, rows = random.Random(2), []
    for k in range(30):  # families that share most of a text, with links inside them and across
        base = [f"b{rng.randint(0, 3)}w{j}" for j in range(24)]
        for _ in range(5):
            words = [w if rng.random() > 0.03 else f"n{rng.randint(0, 9)}" for w in base]
            rows.append((len(rows), " ".join(words)))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)


def test_pairs_of_consecutive_groups():
    from gridweave.llm import minhash as M

    i, j = M._pairs_of(np.array([3, 4, 8]))
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [*itertools.combinations(range(3), 2), *itertools.combinations(range(4, 8), 2)]
    block = np.array([1, 1, 2, 5, 5, 5])
    assert [x for x in M._rounds(block)] == [(0, 6)]


def test_rounds_hold_few_pairs_and_shingles_or_one_block():
    sizes = [2] * 5 + [700] + [3] * 4 + [200] * 4 + [1]
    block = np.repeat(np.arange(len(sizes)), sizes)
    shingles = np.where(block % 7 == 6, M.BLOCK_SHINGLES // 4, 10)
    for weights in (None, shingles):
        rounds = list(M._rounds(block) if weights is None else M._rounds(block, weights))
        assert [a for a, _ in rounds] + [len(block)] == [0] + [z for _, z in rounds]
        for a, z in rounds:
            own = np.unique(block[a:z], return_counts=True)[1]
            assert own.tolist() == [sizes[k] for k in np.unique(block[a:z])]
            few = (own * (own - 1) // 2).sum() <= M.PAIRS and (weights is None or weights[a:z].sum() <= M.BLOCK_SHINGLES)
            assert few or len(own) == 1


def test_a_large_block_after_small_ones_is_not_expanded_into_pairs():
    sizes = [2, 2, 3000, 2]
    block, n = np.repeat(np.arange(4), sizes), np.full(sum(sizes), 40)
    regs = np.random.default_rng(3).integers(1, 1 << 16, (len(n), K.BUCKETS)).astype(np.uint16)
    regs[1], regs[3003] = regs[0], regs[4]
    comp = np.arange(len(n))
    comp[4:] = np.arange(len(n) - 4) // 1000
    rows = pa.RecordBatch.from_arrays([pa.array(x) for x in (block, np.arange(len(n)), n, comp, [r.tobytes() for r in regs])], ["block", "rep", "n", "comp", "regs"])
    tracemalloc.start()
    found = [r for b in M._possible(0.75)([rows]) for r in b.column("rep").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [0, 1, 4, 3003]
    assert peak < 50e6


def test_an_id_of_several_texts_keeps_the_text_of_its_class(spark):
    texts = ["one two three four five six", "one two three four five seven"]
    docs = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (1, texts[1]), (1, None), (2, "alpha beta")], "doc_id long, text string")
    wanted = spark.createDataFrame([(1, bytearray(K.set_digest(K.shingles(texts[1]))))], "rep long, digest binary")
    assert [(r.rep, bytes(r.hashes)) for r in M._sets(docs, wanted, 5).collect()] == [(1, K.shingles(texts[1]).tobytes())]
