import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASH = ("id", "h", "d", "size", "w", "n", "score", "kept", "part", "rank", "uid", "words", "pos", "shard", "slot", "fp", "sig", "bands", "held_out", "i", "y", "t", "l")
WORDS = "the of and river stone window garden letter morning paper silver yellow market winter summer journey little table horse mountain".split()


def sentence(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", str(rng.randint(0, 99))]) for _ in range(n))


def odd_rows():
    long = sentence(40_000, "long") + "\n" + "x" * 200_000
    return [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t\x0b ", "en", "a", 5),
        (4, "Two words", "en", "a", 9),
        (5, long, "en", None, len(long)),
        (6, sentence(80, "a"), "en", "a", 1),
        (7, sentence(80, "a"), None, "b", 1),
        (8, sentence(80, "a") + " more", "de", "b", 1),
        (9, "Ünïcödé ÀÉ 日本語 テキスト \U0001f600 \x85 1234", "xx", "b", 1),
        (None, sentence(60, "b"), "en", "b", 1),
        (None, None, None, None, None),
        (10, sentence(60, "c"), "en", "c", 1),
        (10, sentence(60, "c"), "en", "c", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASH}).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
