import pytest

from stowage.llm.common import prepare

#: Columns of documents, and others whose names the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, runs int, copy boolean, rank int, node string, host string, n long"


def documents(spark, rows):
    """Documents from (doc_id, text, source)."""
    full = [(i, t, "en", s, len(t or ""), 7, "k", 1, True, 2, "x", "h", 3) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(autouse=True)
def prepared(spark):
    prepare(spark)


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and blank texts, one very long text and one very long word, ties and repeated rows."""
    import random

    rng = random.Random(5)
    same = words(rng, 120)
    long = words(rng, 30_000)
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n\x0b\x0c\r ", None), (4, same, "b"), (5, same, "b"), (5, same, "b"), (None, same, None), (None, None, None),
        (6, long, "c"), (7, "x" * 100_000, "c"), (8, "one", "d"), (9, "one two three", "d"), (10, "é\x00ß 日本語 \U0001f600 <|endoftext|> it's", "d"),
        (11, "again " * 500, "b"), (12, same + "\n" + same, "a"), (13, "A\nB\nA\n\nB\nA", "a"), (13, "other text with the same id", "a"),
    ]
    return rows
