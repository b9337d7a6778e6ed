import random

import pytest

LONG = 20_000  # words of the long text


def prose(rng, n, words=None):
    words = words or ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """(id, text): nulls, empty and blank texts, ties, repeated rows, long texts, copies and near copies, shared passages, runs."""
    rng = random.Random(4)
    base, passage = prose(rng, 120), prose(rng, 45)
    words = base.split()
    near = [" ".join("changed" if i == j else w for i, w in enumerate(words)) for j in (3, 40, 77)]
    far = [" ".join("x%d" % i if i % 3 == 0 else w for i, w in enumerate(words))]
    rows = [
        (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one two three"), (6, base), (7, base), (8, base.upper()), (8, base), (9, "One two THREE"),
        (None, base), (None, None), (None, prose(rng, 50)), (20, prose(rng, LONG)), (21, "a " * 100), (22, "a b " * 60), (23, "naïve ÉCOLE 日本語 " * 30),
        *[(30 + i, t) for i, t in enumerate(near + far)], *[(40 + i, f"{prose(rng, 30)} {passage} {prose(rng, 25 * i)}") for i in range(5)],
        (50, passage), (51, " ".join(passage.split()[:20])), (52, " ".join(passage.split()[:19])), (53, f"{passage}\n{passage}"), (54, "x" * 50_000),
    ]
    return rows


@pytest.fixture(scope="session")
def documents(spark, odd_texts):
    """The odd texts as a table whose other columns clash with names that operators use."""
    rows = [(i, t, "en", f"src{n % 5}" if n % 7 else None, len(t) if t is not None else None, n, "x", n, 1.5) for n, (i, t) in enumerate(odd_texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long, id string, n_words long, score double").repartition(3)


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.limit(0)
