import random
import time

import pytest

from gridweave.llm import sentences as S
from gridweave.llm.lines import without_repeated_lines
from gridweave.llm.sentences import sentences, without_repeated_spans


def documents(rows):
    """Distinct documents in the operators' order: by id, null last; texts of one id don't meet in these cases."""
    return sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0]))


def brute_lines(rows, least):
    seen, out = set(), {}
    for i, t in documents(rows):
        parts, gone = t.split("\n"), set()
        for k in range(len(parts) if t else 0):
            n, j = 0, k
            while j < len(parts) and n < least:
                n, j = n + len(parts[j]), j + 1
            if n >= least:
                run = tuple(parts[k:j])
                if run in seen:
                    gone.update(range(k, j))
                seen.add(run)
        out[i, t] = "\n".join(p for k, p in enumerate(parts) if k not in gone), len(gone)
    return out


@pytest.mark.parametrize("least", [1, 60])
def test_lines(docs, corpus, least):
    want = brute_lines(corpus, least)
    by_key = {r[6]: r for r in corpus}
    for r in without_repeated_lines(docs, least_chars=least).collect():
        old = by_key[r["key"]]
        if old[1] is None:
            assert r.text is None and r._n_lines == 0
        else:
            assert (r.text, r._n_deleted) == want[old[0], old[1]]


def test_lines_of_one_document(spark):
    a, b = "a line with characters enough", "another line of some length"
    rows = [(1, "\n".join([a, b, a, b, a, "x", a])), (2, "\n".join(["x", a, b, "y"])), (3, "tiny"), (4, "tiny")]
    got = {r.doc_id: r.text for r in without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: f"{a}\n{b}\nx", 2: "y", 3: "tiny", 4: "tiny"}


def test_empty_tables(empty):
    assert without_repeated_lines(empty).count() == 0 and without_repeated_spans(empty).count() == 0


def brute_spans(rows, width, least):
    seen, out = set(), {}
    for i, t in documents(rows):
        parts = sentences(t)
        words = [S._WORD.findall(p) for p in parts]
        runs, size, n = set(), list(map(len, words)), len(parts)
        for k in range(n):
            total = 0
            for z in range(k, n):
                total += size[z]
                if total >= least and z + 1 - k >= width:
                    runs.add((k, z + 1))
                    break
            total = 0
            for x in range(k, -1, -1):
                total += size[x]
                if total >= least and k + 1 - x >= width:
                    runs.add((x, k + 1))
                    break
        if 0 < len(parts) < width and sum(map(len, words)) >= least:
            runs.add((0, len(parts)))
        gone, own = set(), set()
        for a, z in sorted(runs):
            said = tuple(w.strip() for p in words[a:z] for w in p)
            if said in seen or said in own:
                gone.update(range(a, z))
            own.add(said)
        seen |= own
        out[i, t] = "".join(p for k, p in enumerate(parts) if k not in gone) if parts else t, len(gone)
    return out


@pytest.mark.parametrize("width, least", [(2, 8), (2, 25), (3, 1), (1, 5)])
def test_spans(docs, corpus, width, least):
    want, by_key = brute_spans(corpus, width, least), {r[6]: r for r in corpus}
    for r in without_repeated_spans(docs, width=width, least_words=least).collect():
        old = by_key[r["key"]]
        assert (r.text is None) if old[1] is None else (r.text, r._n_removed, r._n_sentences) == (*want[old[0], old[1]], len(sentences(old[1])))


def test_what_a_sentence_is():
    assert sentences('One two. "Three four!" Five... six\nseven  eight?\n\n nine') == ["One two. ", '"Three four!" ', "Five... ", "six\n", "seven  eight?\n\n ", "nine"]
    assert sentences("  \n a.b c。漢字。かな x") == ["  \n a.b c。", "漢字。", "かな x"]
    assert sentences(" \n\t") == [] and sentences("") == []
    long = " ".join(f"w{k}" for k in range(20)) + ", " + " ".join(f"v{k}" for k in range(20)) + "."
    assert sentences(long) == [long[: long.index(",") + 2], long[long.index(",") + 2 :]]


def test_runs_of_marks_take_linear_time():
    start = time.perf_counter()
    for text in ("." * 200_000 + "x", "a" + "!" * 200_000, ". " * 100_000 + "x", "\n" * 200_000, "word " * 100_000):
        assert "".join(sentences(text)) == (text if text.strip() else "")
    assert time.perf_counter() - start < 10


def test_shared_passage_goes_from_later_documents(spark):
    passage = "The first of these says a thing. The second goes on about it at length. A third closes the case for good."
    rows = [(k, f"Opening number {k} is quite unlike others here. {passage} Ending {k} says what no other does.") for k in range(5)]
    got = {r.doc_id: r.text for r in without_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), least_words=8).collect()}
    assert got[0] == rows[0][1] and all(passage not in got[k] and f"Opening number {k}" in got[k] and f"Ending {k}" in got[k] for k in range(1, 5))


def test_sentences_are_the_text(corpus):
    for r in corpus:
        assert "".join(sentences(r[1] or "")) == (r[1] or "") or not r[1].strip()


def brute_maximal_lines(rows, least):
    """Every line of every longest common run with an earlier place, by comparing all pairs of places."""
    docs, out = documents(rows), {}
    parts = [t.split("\n") if t else [] for _, t in docs]
    for x, (i, t) in enumerate(docs):
        gone = set()
        for s in range(len(parts[x])):
            for y in range(x + 1):
                for e in range(s if y == x else len(parts[y])):
                    n = 0
                    while s + n < len(parts[x]) and e + n < len(parts[y]) and parts[x][s + n] == parts[y][e + n]:
                        n += 1
                    if sum(map(len, parts[x][s : s + n])) >= least:
                        gone.update(range(s, s + n))
        out[i, t] = "\n".join(p for k, p in enumerate(parts[x]) if k not in gone), len(gone)
    return out


@pytest.mark.parametrize("least", [1, 25])
def test_lines_of_maximal_runs(spark, least):
    rng = random.Random(5)
    kinds = ["a line with characters enough", "short", "", "twelve chars", "x", "another line of some length"]
    rows = [(k, "\n".join(rng.choices(kinds, [3, 3, 2, 2, 1, 1], k=rng.randint(1, 9)))) for k in range(40)]
    rows += [(90, "only here at its place, long enough\nshort\n\nend"), (91, "only here at its place, long enough\nshort\n\nend"), (92, "only here at its place, long enough\nshort\nother")]
    got = {(r.doc_id, r.old): (r.text, r._n_deleted) for r in without_repeated_lines(spark.createDataFrame([(i, t, t) for i, t in rows], "doc_id long, text string, old string"), least_chars=least, maximal=True).collect()}
    assert got == brute_maximal_lines(rows, least)
    assert got[91, rows[-2][1]][0] == "" and (least == 1 or got[92, rows[-1][1]][0] == "other")


def test_long_passages_without_marks(spark):
    rng = random.Random(11)
    some = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))
    whole, inside = some(60), some(60)
    rows = [(k, f"Own {some(12)}. {whole}. Then {some(15)} {inside} {some(14)}.") for k in range(3)]
    for text in (r[1] for r in rows):
        assert "".join(sentences(text)) == text
    got = {r.doc_id: r.text for r in without_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    for k in (1, 2):
        left = set(got[k].split())
        assert not left & set(whole.split()) and len(left & set(inside.split())) <= 16
        assert set(rows[k][1].split()) - set(whole.split()) - set(inside.split()) - set(f"{whole}.".split()) <= left


def test_ids_with_several_texts_and_clashing_columns(spark):
    said = "One sentence of this passage has some words in it. Another one follows it and has even more words. The last one ends what all of them say."
    rows = [(None, f"Null first here. {said}", "x"), (None, f"Null again there. {said}", "x"), (7, f"Seven. {said}", "y"), (7, f"Also seven. {said}", "y"), (7, f"Seven. {said}", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _d string").selectExpr("*", "5 as `_runs`", "1 as _n_removed")
    got = without_repeated_spans(df).collect()
    assert all(r._runs == 5 and r._d == ("x" if r.doc_id is None else "y") for r in got)
    whole = {r.text for r in got if said in r.text}
    assert len(whole) == 1 and {r.doc_id for r in got if said in r.text} == {7} and all(r._n_removed == 3 for r in got if said not in r.text)


def test_lines_beside_clashing_columns(spark):
    rows = [(k, "a line with characters enough\nand one of this document alone" + str(k), "x", 7) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _th string, _runs int").selectExpr("*", "1 as _n_deleted", "2 as d")
    got = {r.doc_id: r for r in without_repeated_lines(df, maximal=True).collect()}
    assert [got[k]._n_deleted for k in range(3)] == [0, 1, 1] and all(r._th == "x" and r._runs == 7 and r.d == 2 for r in got.values())
