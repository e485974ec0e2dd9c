import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("h", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("uid", T.StringType())])


def words(rng, n):
    return " ".join("".join(rng.choice("aeioulnrstdk") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts by id: unlike ones, copies, near copies, shared passages, repeats in one text, short, empty and very long ones."""
    rng = random.Random(4)
    out = {i: words(rng, rng.randint(20, 160)) for i in range(60)}
    for i in range(60, 80):  # near copies of a few texts, one or two words away
        parts = out[i % 7].split()
        for _ in range(rng.randint(1, 2)):
            parts[rng.randrange(len(parts))] = "changed"
        out[i] = " ".join(parts)
    for i in range(80, 92):  # exact copies
        out[i] = out[i % 3]
    passage = words(rng, 90)
    for i in range(92, 104):
        out[i] = f"{words(rng, rng.randint(5, 30))} {passage} {words(rng, rng.randint(5, 30))}"
    out |= {104: "", 105: None, 106: "a", 107: "A  b\tc", 108: "x" * 1500, 109: "grüße 漢字 " * 80, 110: words(rng, 6000), 111: "  \n ", 112: "a b c", 113: "token = abcdefgh " + "0123456789abcdef" * 3}
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with columns whose names clash with those that the operators use inside."""
    return spark.createDataFrame([(i, t, i, "k", "u") for i, t in texts.items()], DOCS).repartition(5)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and repeated ids, repeated rows."""
    rows = [(None, "same text here now ok fine", 1, None, None), (None, "same text here now ok fine", 1, None, None), (5, "same text here now ok fine", None, "a", "b"), (5, "same text here now ok fine", None, "a", "b"), (5, "something else altogether is said here", 2, "a", "b"), (None, None, None, None, None), (7, None, 1, "", "")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
