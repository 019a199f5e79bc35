"""Small documents with every case the operators define."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                          T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                          T.StructField("n_chars", T.LongType())])


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["an", "er", "st", "ou", "ble", "é", "tion"]) for _ in range(rng.randint(1, 4)))
                    for _ in range(n))


def edited(text, seed, n):
    rng, parts = random.Random(seed), text.split()
    for k in rng.sample(range(len(parts)), n):
        parts[k] = f"new{seed}x{k}"
    return " ".join(parts)


def documents():
    """Rows of (doc_id, text): originals, copies, near copies, shared passages and odd rows."""
    rows, passage = [], words(900, 90)
    for i in range(40):
        rows.append((i, words(i, 60 + i)))
    for i in range(40, 60):
        rows.append((i, rows[i % 5][1]))                                    # exact copies
    for i in range(60, 90):
        rows.append((i, edited(words(3, 120), i, 1 + i % 9)))               # near copies of one text
    for i in range(90, 110):
        rows.append((i, words(i, 20) + " " + passage + " " + words(-i, 15)))  # a common passage
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "one"), (204, "One"), (205, "One two"), (206, "é" * 900),
             (207, words(77, 4000)), (208, "a" * 1500), (209, "ab " * 700), (None, words(1, 61)), (None, None),
             (7, rows[7][1]), (8, "another text under a used number"), (210, "x y z Ünï " + passage)]
    return rows


def frame(spark, rows):
    langs, sources = ["en", "de", "fr", "es", None], ["src0", "src0", "src1", "src12", None, "odd'name"]
    full = [Row(i, t, langs[k % 5], sources[k % 6], None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCUMENTS)


@pytest.fixture(scope="session")
def docs(spark):
    return frame(spark, documents())


@pytest.fixture(scope="session")
def no_docs(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with columns that bear the operators' own names."""
    from pyspark.sql import functions as F
    names = ["_cut", "_score", "score", "label", "uid", "h", "k1", "g", "spans", "epoch", "domain", "_row", "_t", "size"]
    return docs.withColumns({n: F.lit(1) for n in names})
