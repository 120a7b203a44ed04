import math
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from gridweave.llm import language as L
from gridweave.llm.mixing import emitted, mixed, targets

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_forward_sums_all_segmentations():
    pieces = L.Pieces(MODEL)
    p = np.random.default_rng(1).random((pieces.size, 2)) / pieces.size
    p[0], p[1] = 0, L.UNKNOWN
    words = [L.START + w for w in ("the", "house", "ß漢", "a" * 40)]

    def slow(word, k):
        known = {}
        for (s, e), piece in pieces.edges([word]).items():
            known[s, e] = p[piece[0], k]
        total = [1.0] + [0.0] * len(word)
        for e in range(1, len(word) + 1):
            total[e] = math.fsum(total[s] * known.get((s, e), 0.0) for s in range(e))
        return math.log(total[-1])

    for w in words:
        got = pieces.forward(pieces.edges([w]), len(w), pieces.lifted(p), 1)[1][0]
        assert got == pytest.approx([slow(w, 0), slow(w, 1)], rel=1e-9)


@pytest.fixture(scope="module")
def speech(spark):
    rng = random.Random(3)
    stock = {"en": "the and house with this that people over water", "de": "der und haus mit dieses dass leute über wasser", "fr": "le et maison avec ceci que gens sur eau"}
    rows = []
    for i in range(240):
        lang = ["en", "de", "fr"][i % 3]
        rows.append((i, " ".join(rng.choice(stock[lang].split()) for _ in range(rng.randint(5, 40))), None if i % 10 == 9 else lang))
    rows += [(900, None, "en"), (901, "12 34 !!", None), (902, "", "de"), (None, "the house", None), (903, "w" * 5000, None), (3, rows[3][1], "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


def test_held_out_accuracy(speech):
    df, rows = speech
    truth = {r[0]: ["en", "de", "fr"][r[0] % 3] for r in rows if r[0] is not None and r[0] < 240}
    got = L.identify(df, MODEL).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id < 240]
    assert len(held) > 30 and all(r.lang_pred == truth[r.doc_id] for r in held)
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert by[None].lang_pred == "en" and all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn_from(spark, speech):
    df, _ = speech
    assert {r.lang_pred for r in L.identify(df.withColumn("lang", df.lang.cast("string")).where("false"), MODEL).collect()} == set()
    blank = df.drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {r.lang_pred for r in L.identify(blank, MODEL).collect()} == {"und"}


def test_targets_are_shared_by_weight(spark):
    sizes = spark.createDataFrame([(False, "a", 100), (False, "b", 10), (False, "c", 500), (True, "", 0)], "_null boolean, _source string, source_size long")
    got = {r._source: r.target for r in targets(sizes).collect()}
    # b stops at 30; the other 580 go by 5 to 1, a stops at 300.
    assert got == pytest.approx({"a": 300, "b": 30, "c": 280, "": 0})


def test_mix_takes_the_targets(docs, corpus):
    rows = mixed(docs).collect()
    assert len(rows) == len(corpus)
    words = lambda t: len((t or "").encode().split())
    taken, size, copies = defaultdict(int), defaultdict(int), defaultdict(list)
    for r in rows:
        assert r._size == words(r.text) and 0 <= r._copies <= 3
        taken[r.source] += r._copies * r._size
        size[r.source] += r._size
        copies[r.source].append((r._copies, r._target / r._source_size))
    for s, c in copies.items():
        assert abs(sum(k for k, _ in c) - sum(rate for _, rate in c)) <= 1
    assert sum(r._target / sum(1 for x in rows if x.source == r.source) for r in rows) == pytest.approx(sum(size.values()))
    assert sorted((str(r.doc_id), r._copies) for r in rows) == sorted((str(r.doc_id), r._copies) for r in mixed(docs.repartition(5)).collect())


def test_clashing_columns_and_many_null_ids(spark):
    rows = [(None, f"words of text {k % 40}", "a", 1, "p") for k in range(200)] + [(k, "one two", "b", 2, "q") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _n int, _null string").selectExpr("*", "'old' as _size")
    got = mixed(df).collect()
    assert len(got) == len(rows) and all(r._size in (2, 4) and r._null == {1: "p", 2: "q"}[r._n] for r in got)
    again = mixed(df.repartition(7), texts=False)
    assert "text" not in again.columns
    assert sorted((str(r.doc_id), r._copies) for r in again.collect()) == sorted((str(r.doc_id), r._copies) for r in got)


def test_emitted_rows(docs, empty):
    assert emitted(docs).count() == sum(r._copies for r in mixed(docs).collect())
    assert emitted(docs).columns == docs.columns and emitted(empty).count() == 0


def vocabulary():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    plain = [k for k in range(model.get_piece_size()) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))]
    return {w: k + 2 for k, w in enumerate(sorted({model.id_to_piece(k) for k in plain}))}


def segmentations(word, known):
    """All ways to cut a word into pieces, with row 1 for a character that is none."""
    if not word:
        yield []
    for e in range(1, len(word) + 1):
        row = known.get(word[:e], 1 if e == 1 else None)
        if row is not None:
            for rest in segmentations(word[e:], known):
                yield [row, *rest]


def brute_counts(words, n, p, known):
    total = np.zeros(len(known) + 2)
    for word, times in zip(words, n, strict=True):
        ways = list(segmentations(L.START + word, known))
        chances = np.array([math.prod(p[k] for k in way) for way in ways])
        for way, share in zip(ways, chances / chances.sum(), strict=True):
            np.add.at(total, way, times * share)
    return total


@pytest.mark.parametrize("long", [2, 256])
def test_expected_counts_are_those_of_all_segmentations(monkeypatch, long):
    monkeypatch.setattr(L, "LONG", long)
    known, pieces = vocabulary(), L.Pieces(MODEL)
    assert pieces.size == len(known) + 2
    p = np.random.default_rng(2).random(pieces.size) / pieces.size
    p[0], p[1] = 0, L.UNKNOWN
    words, n = ["the", "houses", "ß漢x", "a", "und"], np.array([3, 1, 2, 5, 4])
    assert L.expected_counts(pieces, words, n, p) == pytest.approx(brute_counts(words, n, p, known), rel=1e-9, abs=1e-15)


@pytest.mark.parametrize("size", [300, 5000])
def test_long_words(size):
    pieces, rng = L.Pieces(MODEL), random.Random(size)
    p = np.random.default_rng(1).random((pieces.size, 2)) / pieces.size
    p[0], p[1] = 0, L.UNKNOWN
    word, lifted = L.START + "".join(rng.choices("abcdeß漢", k=size)), pieces.lifted(p)
    want = [pieces.forward(pieces.edges([word]), len(word), lifted[:, [k]], 1)[1][0, 0] for k in (0, 1)]
    assert pieces.long_forward(word, lifted) == pytest.approx(want, rel=1e-9)
    assert pieces.long_forward(word, lifted, step=64) == pytest.approx(want, rel=1e-9)
    counts = pieces.long_counts(word, lifted[:, 0])
    # Each segmentation covers every character once.
    assert (counts * pieces.lengths).sum() == pytest.approx(len(word), rel=1e-6)


def test_learning_is_the_same_as_by_hand(spark):
    known = vocabulary()
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the house the", "en"), ("das haus", "de"), ("a house", "en"), ("ein", "de"), ("½ x²", "en")] * 3)]
    langs, p = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), MODEL, rounds=2)
    assert langs == ["de", "en"]
    for k, lang in enumerate(langs):
        q = np.full(len(known) + 2, 1 / (len(known) + 2))
        words = defaultdict(int)
        for _, text, own in rows:
            if own == lang:
                for w in text.replace("½", " ").replace("²", " ").split():
                    words[w] += 1
        for _ in range(2):
            q[0], q[1] = 0, L.UNKNOWN
            q, n = np.full(len(known) + 2, L.SMOOTHING), brute_counts(list(words), list(words.values()), q, known)
            q += n
            q[:2] = 0
            q /= q.sum()
        q[1] = L.UNKNOWN
        assert p[:, k] == pytest.approx(q, rel=1e-6, abs=1e-15)


def test_numerals_are_no_letters_and_clashing_columns(spark, speech):
    df, _ = speech
    more = df.unionByName(spark.createDataFrame([(950, "½ ² Ⅷ ³ 一", None), (951, "½ ² Ⅷ ³ ①", None)], df.schema)).selectExpr("*", "1 as _score", "'x' as _lang_pred", "2 as `n`")
    got = {r.doc_id: r for r in L.identify_rows(more, MODEL).collect()}
    assert got[951]._lang_pred == "und" and got[951]._score == 0.0 and got[951].n == 2
    assert got[950]._lang_pred != "und"


def test_rows_without_ids_teach_too(spark):
    rng = random.Random(4)
    stock = {"en": "the and house with this that people over water", "de": "der und haus mit dieses dass leute über wasser"}
    rows = [(None, " ".join(rng.choice(stock[k].split()) for _ in range(12)), k) for k in ("en", "de") for _ in range(120)]
    langs, p = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), MODEL, rows_per_lang=20)
    assert langs == ["de", "en"] and not np.allclose(p[:, 0], p[:, 1])
