import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, kept string, row string, value long"


def prose(rng, words):
    return " ".join(rng.choice(["re", "tion", "an", "the", "of", "est", "ing"]) + rng.choice(["a", "on", "er", "ly", "", "Qu"]) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows and columns whose names operators use inside."""
    rng = random.Random(7)
    base = [prose(rng, n) for n in (60, 61, 80, 120, 200, 400, 30, 12)]
    near = [t.replace(" ", " ", 1) + f" tail{k}" for k, t in enumerate(base[:5])]
    edited = []
    for t in base[2:6]:
        words = t.split()
        words[len(words) // 2] = "changed"
        edited.append(" ".join(words))
    shared = prose(rng, 50)
    texts = [None, "", " \t\n", "one", "Two words", "two WORDS", "a b c d e", "\n\n", *base, *near, *edited, base[3], base[3], base[3].upper()]
    texts += [shared + " " + prose(rng, 25), prose(rng, 25) + "\n" + shared, prose(rng, 6000), "x " * 3000, "é" * 3000, "Line one here.\nLine one here!\n- Line  ONE here\nother line\n\n***"]
    rows = [(k, t, ["en", None, "xx"][k % 3], ["src0", None][k % 2], len(t or ""), -k, k, "x", "y", 1) for k, t in enumerate(texts)]
    return [*rows, rows[10], rows[10], (None, base[3], None, None, None, None, None, None, None, None), (5, prose(rng, 70), "en", "s", 1, 1, 1, "", "", 1)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
