import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("id", "n", "c", "i", "j", "fp", "sig", "bucket", "node", "component", "blocks", "shard", "slot", "_h", "_d", "_r", "_id", "severity", "uid", "training", "score", "grp", "sums", "start", "rank", "query_id", "license", "_lines")


def prose(seed, n):
    rnd = random.Random(seed)
    words = ["the", "and", "of", "erth", "onding", "athe", "iner", "shon", "ble", "tion", "heand", "ouer"]
    return " ".join(rnd.choice(words) + rnd.choice(["", "", ",", ".", "s"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns of clashing names."""
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (3, " \n\t ", "en", "s", 4), (4, prose(1, 300), "en", "s", 5), (4, prose(1, 300), "en", "s", 5),
            (5, prose(1, 300), "en", "s", 5), (6, prose(2, 60_000), "en", None, 5), (None, prose(3, 50), "en", "s", 5), (None, None, None, None, None),
            (7, "12 34 !?", "en", "s", 8), (8, "word", "de", "s", 4), (9, "日本語のテキスト 🙂 é́", "de", "s", 4), (10, "\x00\x0b a b c\x85d", "fr", "s", 3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHES))


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
