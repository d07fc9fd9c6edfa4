import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
#: Names that the operators use themselves.
CLASHES = ["score", "lang_pred", "_d", "_h", "_rest", "_rank", "fp", "text_hash", "terms", "length", "_nth", "_words", "size", "taken", "held_out", "quality", "host"]


def prose(seed, n=80):
    r = random.Random(seed)
    pool = ["the", "of", "and", "river", "stone", "light", "walks", "under", "green", "hill", "seven", "paper", "north", "quiet", "water", "road"]
    return " ".join(r.choice(pool) + (r.choice(pool) if r.random() < 0.5 else "") for _ in range(n)) + "."


def edge_rows():
    base = prose(0)
    rows = [
        (0, base, "en", "a"), (1, None, "en", "a"), (2, "", None, None), (3, " \t\n ", "fr", "b"), (4, "x", "en", None),
        (5, base, "en", "a"), (5, base, "en", "a"), (6, prose(1), "en", "b"), (6, prose(2), "en", "b"), (None, base, "en", "a"),
        (None, prose(3), None, None), (None, prose(3), None, None), (7, "word " * 30_000, "en", "a"), (8, "y" * 200_000, "en", "c"),
        (9, base + " more", "en", "c"), (10, "a@b.co 1.2.3.4 or 4111 1111 1111 1111 +1 (743) 555-3824", "fr", "c"), (11, "é中\U0001f600    x", "fr", "c"),
        (12, "42 43 !!", "fr", "c"), (13, "line one\nline one\nline one\n", "en", "a"), (-1, prose(4), "fr", "b"),
    ]
    rows += [(20 + i, prose(10 + i), ("en", "fr")[i % 2], "abc"[i % 3]) for i in range(12)]
    return [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in rows]


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls, empty, blank and very long texts, repeats, and columns with the operators' own names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows(), DOCS)
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
