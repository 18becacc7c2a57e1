import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
#: Names that the operators use inside.
CLASHING = ("id", "i", "s", "n", "k", "key", "doc", "tkey", "fp", "rid", "name", "level", "size", "copies", "score", "ids", "place", "gone", "spans", "h")


def words(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def edge_rows() -> list[tuple]:
    shared = words(1, 60)
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n\x0b\x0c\r ", "en", "a", 7),
        (4, words(4, 80) + "\n" + shared, "en", "a", None),
        (5, words(5, 30) + "\n" + shared + "\n" + words(6, 9), "en", "b", None),
        (6, shared, "en", "b", None),
        (7, shared.replace(" ", "  "), None, "b", None),
        (7, shared.replace(" ", "  "), None, "b", None),  # a repeated row
        (8, words(8, 25), "de", None, None),
        (8, words(9, 25), "de", None, None),  # a repeated id with another text
        (None, words(4, 80) + "\n" + shared, None, "c", None),
        (None, None, None, None, None),
        (9, "Ünïcode ▁ text \U0001f600 with ﬁgures and odd spaces", "fr", "ß", None),
        (10, words(10, 40_000, 9000), "en", "c", None),  # very long
        (11, "x" * 150_000, "en", "c", None),  # one very long word
        (12, "a " * 400, "en", "c", None),  # one word again and again
        (13, "a " * 300, "en", "c", None),
        (14, "two words", "en", "\U0001f600", None),
        (15, "Two words", "en", "\U0001f600", None),
    ]
    return rows + [(100 + k, words(100 + k, 50 + k), "en", f"s{k % 4}", None) for k in range(40)]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def clashing(edge):
    from pyspark.sql import functions as F

    return edge.select("*", *(F.lit(f"extra {c}").alias(c) for c in CLASHING))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
