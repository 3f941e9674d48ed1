"""Documents with the hard cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    *(T.StructField(n, T.StringType()) for n in (
        "fingerprint", "key", "a", "content", "piece", "length", "ids", "score", "keep", "features"))])


def rows(items):
    return [(i, t, "en", "s", len(t or ""), *["x"] * 10) for i, t in items]


def sentences(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeéü", k=r.randint(1, 6))) for _ in range(60)]
    return [" ".join(r.choices(words, k=r.randint(1, 40))) for _ in range(n)]


@pytest.fixture(scope="session")
def hard_items():
    shared = "This line stands in very many of the documents here.  "
    plain = sentences(1, 30)
    items = [(i, "\n".join([plain[i], shared if i % 2 else shared.upper(), "short", plain[i]]))
             for i in range(30)]
    items += [(100, None), (101, ""), (102, " \t\n\n"), (103, "\r\n" + shared), (104, "one"),
              (105, "one two"), (106, "word " * 30000), (107, "x" * 5000), (None, shared), (None, None),
              (5, "another row of the same id\n" + shared), (7, items[7][1]), (7, items[7][1]),
              (108, "Ünï ÇÖDÉ 漢字 😀 <|endoftext|> \x1c   ſ Σ"), (109, shared + "\n" + shared),
              (110, "a\x00b"), (-3, plain[3])]
    return items


@pytest.fixture(scope="session")
def hard_documents(spark, hard_items):
    return spark.createDataFrame(rows(hard_items), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
