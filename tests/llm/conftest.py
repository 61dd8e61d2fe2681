import random

import pytest
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

DOCS = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
    StructField("source", StringType()), StructField("n_chars", LongType()),
])


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def frame(spark, rows):
    """Documents from (doc_id, text[, lang[, source]])."""
    full = [(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    rng = random.Random(1)
    base = prose(rng, 120)
    near = base.split()
    near[3] = "changed"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), None, None),
        (4, None, None, None), (None, None, None, None), (5, "", "en", "b"), (6, " \n\t ", "en", "b"),
        (7, "two words", "de", "b"), (8, "TWO words", "de", "b"), (None, base, "en", None), (9, prose(rng, 30_000), "en", "b"),
        (10, "one", None, "c"), (11, "x" * 300_000, None, "c"), *((20 + i, prose(rng, 60), "fr", "d") for i in range(40)),
    ]
    docs = frame(spark, rows)
    for name in ("score", "node", "group", "copies", "row_hash", "pii_found", "part", "length", "text_hash"):
        docs = docs.selectExpr("*", f"'clash' as {name}")
    return docs


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    kinds = StructType([StructField("doc_id", LongType()), StructField("quality", IntegerType()), StructField("toxic", IntegerType())])
    rows = [(20 + i, int(i % 4 != 0), int(i % 5 == 0)) for i in range(40)] + [(None, 1, 1), (1, None, None), (999, 0, 1)]
    return spark.createDataFrame(rows, kinds)
