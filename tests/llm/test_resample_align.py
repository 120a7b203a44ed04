"""Resampling against SQL and plain CRCs, alignment against a plain loop over tokens."""
import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
from gridweave.llm.align import aligned, byte_level_tokens, links, piece_tokens, token_groups
from gridweave.llm.queries import RESAMPLE_SQL
from gridweave.llm.resample import combine, features, ngram_crcs, resampled
from gridweave.llm.shared import only

NAMES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SORTED = lambda rows: sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r))


def test_crcs_are_composed():
    rng = random.Random(3)
    words = [bytes(rng.randrange(97, 123) for _ in range(rng.choice([1, 2, 7, 300]))) for _ in range(60)]
    crc, size = np.array([zlib.crc32(w) for w in words], np.uint32), np.array([len(w) for w in words])
    assert combine(crc[:-1], crc[1:], size[1:]).tolist() == [zlib.crc32(a + b) for a, b in zip(words, words[1:])]
    document = np.arange(60) // 20
    for n, (who, found) in enumerate(ngram_crcs(crc, size, document, 4), 1):
        want = [(k // 20, zlib.crc32(b" ".join(words[k : k + n]))) for k in range(60 - n + 1) if document[k] == document[k + n - 1]]
        assert list(zip(who.tolist(), found.tolist())) == want


def test_no_words_and_few_words_have_no_ngrams():
    none = np.empty(0, np.uint32)
    assert [len(c) for _, c in ngram_crcs(none, none.astype(int), none.astype(int), 3)] == [0, 0, 0]
    assert [len(c) for _, c in ngram_crcs(np.array([5], np.uint32), np.array([1]), np.array([0]), 3)] == [1, 0, 0]


def test_bigrams_of_texts(spark):
    texts = ["One two, THREE", None, "", "é É x", "one"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_features, np.frombuffer(r.buckets, "<u4").tolist()) for r in features(rows, 2, 100_000).collect()}
    words = {0: ["one", "two", "three"], 1: [], 2: [], 3: ["é", "É", "x"], 4: ["one"]}
    for k, w in words.items():
        grams = w + [" ".join(x) for x in zip(w, w[1:])]
        assert got[k] == (len(w), len(grams), [zlib.crc32(g.encode()) % 100_000 for g in grams])


def test_resampling_equals_sql(spark, docs, corpus):
    target = [(1, "abcdef gh " * 9), (2, None), (3, "cab fed ab")]
    goal = spark.createDataFrame(target, "item_id long, text string")
    got = SORTED(resampled(docs, goal).collect())
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(r[0], r[1]) for r in corpus])
    con.execute("create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into benchmark values (?, ?)", target)
    found = con.execute(RESAMPLE_SQL)
    names = [x[0] for x in found.description]
    want = SORTED(tuple(r[names.index(c)] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in found.fetchall())
    assert got == want and sum(r[4] is not None for r in got) >= 3


def test_resampling_of_nothing(spark, empty, docs):
    none = spark.createDataFrame([], "text string")
    assert resampled(empty, none).collect() == []
    assert resampled(docs, none).count() == docs.count()


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    t, m = Tokenizer.from_file(NAMES[0]), sentencepiece.SentencePieceProcessor(model_file=NAMES[1])
    t.encode_special_tokens = True
    of_a, of_b, held, count, best = byte_level_tokens(NAMES[0]), piece_tokens(m), [], Counter(), Counter()
    for who, text in rows:
        groups = []
        if text:
            a, b, i, j = t.encode(" " + text, add_special_tokens=False).ids, m.encode(text), 0, 0
            if b"".join(of_a[x] for x in a) == b"".join(of_b[x] for x in b) == (" " + text).encode():
                ours, theirs, size = [], [], [0, 0]
                while i < len(a) or j < len(b):
                    if size[0] <= size[1]:
                        ours.append(a[i])
                        size[0] += len(of_a[a[i]])
                        i += 1
                    else:
                        theirs.append(b[j])
                        size[1] += len(of_b[b[j]])
                        j += 1
                    if size[0] == size[1]:
                        groups.append((ours, theirs))
                        ours, theirs = [], []
        held.append((who, groups))
        count.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for who, groups in held:
        pairs = [(x, y) for g in groups for x in g[0] for y in g[1]]
        written = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((who, *(sum(len(g[k]) for g in groups) for k in (0, 1)), len(groups), len(pairs), hashlib.sha256(written.encode()).hexdigest() if groups else "", sum(count[p] == best[p[0]] for p in pairs), sum(count[p] for p in pairs)))
    return out


def test_alignment_equals_a_plain_loop(spark, docs, corpus):
    assert SORTED(aligned(docs, *NAMES).collect()) == SORTED(plain_alignment([(r[0], r[1]) for r in corpus]))


def test_alignment_of_odd_texts(spark):
    rng = random.Random(5)
    bits = ["a", "the ", " ", "\n", "\t", "1", "é", "漢", "'s", "́", "<", "|endoftext|>", "<s>", "\r", "\r\n", "  ", ".", "​", "Zing", "▁", "\0", "🙂", "<0x0A>"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for k in range(150)]
    rows += [(200, " "), (201, "\n"), (202, "ab" * 4000), (203, "x" * 70_001), (204, "<|endoftext|>"), (205, " two"), (206, None)]
    assert SORTED(aligned(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), *NAMES).collect()) == SORTED(plain_alignment(rows))


def test_alignment_of_nothing(spark, empty):
    assert aligned(only(empty, doc_id="doc_id", text="text"), *NAMES).collect() == []


def test_groups_and_long_groups():
    length, a, b = token_groups(bytes([0, 3, 1, 2, 3, 3]))
    assert (length.tolist(), a.tolist(), b.tolist()) == ([2, 3, 1], [1, 2, 1], [1, 2, 1])
    ours, theirs = np.arange(200) % 3, np.arange(150) % 2
    _, pairs, numbers = links(ours, theirs, np.array([200]), np.array([150]), np.array([0]))
    want = Counter((int(x) << 20) | int(y) for x in ours for y in theirs)
    assert dict(zip(pairs.tolist(), numbers.tolist())) == want


def test_few_pairs_in_a_chunk(docs, corpus):
    assert SORTED(aligned(docs.coalesce(1), *NAMES, chunk_pairs=500).collect()) == SORTED(plain_alignment([(r[0], r[1]) for r in corpus]))
