import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `_extra` string, `key` int"


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with nulls, empty and long texts, copies, near copies, repeated rows and clashing extra columns."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    base = ["\n".join(line(rng.randint(4, 14)) for _ in range(rng.randint(1, 8))) for _ in range(60)]
    texts = list(base)
    texts += [base[3], base[3], base[5] + "\n" + line(3), base[7].replace(base[7].split()[2], "zzz", 1)]
    texts += [base[9] + "\n" + base[10], "", None, "   \n\t ", "one two", "one two", "a b c d e f", "x" * 3000, " ".join(words * 40), "\n".join([base[0]] * 30), "Ünïcode ÉÉ … 漢字 \u001c ﬁ"]
    rows = [(i * 3 % 101 if i % 9 else i * 3 % 101, t, ["en", "de", None][i % 3], ["a", "a", "a", "b", None, "c"][i % 6], len(t or ""), "e", i) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, base[3], None, None, 0, None, None), (None, None, "en", "b", 0, None, 777)]
    return rows


@pytest.fixture
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
