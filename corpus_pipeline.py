"""A corpus pipeline: toxic documents go, documents without a recognisable language go, one
document of each group of near-duplicates stays, and the rest is packed into sequences.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwave.llm import common, langid, neardup, packing, toxicity

#: Texts of which their language's filter knows a smaller part of the n-grams go. Prose
#: of a learned language has over 0.4 of them, even amid numbers and marks.
LEAST_LANGUAGE = 0.2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity stays below the operator's bound. A null text has
    the severity of a text without features, and stays."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep(docs, model)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the corpus. A text that is null or has no
    letter, or hardly any n-gram of a language, goes. If no document has a label, all with
    letters are unknown and none goes."""
    model = langid.fit(docs)
    return langid.keep(docs, model, LEAST_LANGUAGE) if model.languages else docs


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that hangs together at a similarity of 0.8 of five-word
    shingles: the one of the smallest id. Each row is judged by its own text, so rows that
    repeat an id with other texts stay; rows without an id, and texts without words, all
    stay."""
    return neardup.keep_first(docs, k=5, threshold=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 ids."""
    return packing.pack(docs, "byte_bpe_50k.json")


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: SQL expresses neither the models nor the packing; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the table that the one before has written."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.written(docs)
    return docs
