"""The stages against plain versions, each on its own input."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import corpus_pipeline as P
import numpy as np
import public_tokenizers
import pytest
from test_language_mixing import vocabulary
from test_lines_sentences import brute_maximal_lines
from test_near import brute as near_components

from gridweave.llm import language as L
from gridweave.llm.shared import saved

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def given(docs):
    return docs.select(*NAMES)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def plain_languages(df, corpus):
    """The prediction of each text by sums over all segmentations, word by word."""
    known = vocabulary()
    teaches = df.where(~L.held_out(df.doc_id)).select("doc_id", "text", "lang")
    langs, p = L.fit(teaches, public_tokenizers.path("piece_bpe_32k.model"))
    longest, logs = max(map(len, known)), {}

    def word_logs(word):
        if word not in logs:
            total = np.zeros((len(word) + 1, len(langs)))
            total[0] = 1
            for e in range(1, len(word) + 1):
                for s in range(max(0, e - longest), e):
                    row = known.get(word[s:e], 1 if e - s == 1 else None)
                    if row is not None:
                        total[e] += total[s] * p[row]
            logs[word] = np.log(np.maximum(total[-1], 1e-300))
        return logs[word]

    out = {}
    for text in {r[1] for r in corpus}:
        words = L.words_of(text)
        if words and max(map(len, words)) < 100:
            x = sum(word_logs(L.START + w) for w in words)
            share = np.exp(x - x.max())
            out[text] = langs[int(x.argmax())], float(share.max() / share.sum())
        elif not words:
            out[text] = "und", 0.0
    return out


def test_language_stage(spark, given, corpus):
    kept = rows_of(P.language_id(spark, given, ""))
    want = plain_languages(given, corpus)
    for r in corpus:
        if r[1] in want and abs(want[r[1]][1] - P.LEAST_SCORE) > 1e-6:
            lang, score = want[r[1]]
            assert (tuple(r[:5]) in kept) == (lang != "und" and score >= P.LEAST_SCORE), r[1]
    assert not kept - Counter(tuple(r[:5]) for r in corpus)


def test_line_stage(spark, given, corpus):
    want, out = brute_maximal_lines(corpus, 25), Counter()
    for r in corpus:
        text, gone = (None, 0) if r[1] is None else want[r[0], r[1]]
        if not gone or text.strip():
            out[(r[0], text, r[2], r[3], None if text is None else len(text))] += 1
    assert rows_of(P.line_dedup(spark, given, "")) == out


def test_near_stage(spark, given, corpus):
    component = {i: c for i, _, c in near_components(corpus)}
    assert rows_of(P.near_dedup(spark, given, "")) == Counter(tuple(r[:5]) for r in corpus if r[0] is None or component[r[0]] == r[0])


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), set(sizes), {}
    while open_:
        heavy = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / heavy > most * sizes[s]}
        if not over:
            target.update({s: left * weight[s] / heavy for s in open_})
            break
        target.update({s: most * sizes[s] for s in over})
        left, open_ = left - sum(most * sizes[s] for s in over), open_ - over
    return target


def test_mix_stage(spark, given, corpus):
    size = lambda r: len((r[1] or "").encode().split())
    groups = defaultdict(list)
    for r in corpus:
        groups[r[3]].append(r)
    target, out = plain_targets({s: sum(map(size, g)) for s, g in groups.items()}), Counter()
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    for s, group in groups.items():
        total = sum(map(size, group))
        rate = min(target[s] / total, 3.0) if total else 0.0
        shift = int(md5("mix:" + ("-" if s is None else "+" + s))[:12], 16) / 2**48
        bits = lambda n: max(n.bit_length(), 1)
        klass = lambda n: bits(n) * 8 + int(n / 2.0 ** max(bits(n) - 4, 0)) % 8
        group.sort(key=lambda r: (klass(size(r)), md5(str(r[0]) if r[0] is not None else (r[1] or ""))))
        for k, r in enumerate(group, 1):
            out[tuple(r[:5])] += math.floor(k * rate + shift) - math.floor((k - 1) * rate + shift)
    assert rows_of(P.mix_sources(spark, given, "")) == +out


def test_pack_stage(spark, given, corpus):
    from tokenizers import Tokenizer

    tokenizer, want, bins = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter(), defaultdict(list)
    for r in corpus:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            want[r[0], k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += 1
    got = P.pack(spark, given, "").collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        ends = [0]
        for offset, length in sorted(held):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 4096
    assert len(bins) <= -(-sum(k[3] * n for k, n in want.items()) // 4096) + 1


def test_stages_follow_each_other(spark, given):
    now = given
    for name, stage in P.STAGES:
        after = saved(stage(spark, now, ""), name)
        if name != "pack":
            assert after.columns == NAMES
            assert all(r.n_chars == len(r.text) for r in after.collect()) or name == "language_id"
        now = after
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(now.columns) and now.count() > 0


def test_stages_of_nothing(spark, empty):
    now = empty.select(*NAMES)
    for name, stage in P.STAGES:
        now = saved(stage(spark, now, ""), name)
        assert now.count() == 0


def test_names():
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix_sources", "pack"] and P.ORACLE_SQL is None
