"""Pieces that several operators share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, which the session's ``spark.checkpoint.dir`` names.
    Only where that is unset, as in tests on a local master, is a temporary folder used."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` from the cluster's checkpoint folder, so that later plans neither repeat
    its work nor lose it with an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same as a Parquet table in that folder: compressed, and later plans read only
    the columns they need; for tables with texts."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Keys of more rows than this part of all, and than HOT_ROWS, are hot; so at most so many are.
HOT_KEYS, HOT_ROWS = 1000, 100


def join_hot(rows: DataFrame, side: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined by ``key`` with ``side``, which has one row for each key and in
    ``count`` the number of its rows; ``total`` is the number of all rows, or more.

    Keys of over max(HOT_ROWS, total / HOT_KEYS) rows, of which there can't be more than
    HOT_KEYS, are sent to every task, so their rows meet them where they are. All others are
    joined as usual. A null key matches nothing and isn't shuffled.
    """
    least = max(HOT_ROWS, total // HOT_KEYS)
    rest = [c for c in side.columns if c != key]
    hot = side.filter(F.col(count) > least).select(key, F.struct(*rest).alias("_hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    at_once = F.col("_hot").isNotNull() | F.col(key).isNull() if how == "left" else F.col("_hot").isNotNull()
    met = marked.filter(at_once).select(*rows.columns, *(F.col(f"_hot.{c}").alias(c) for c in rest))
    others = marked.filter(F.col("_hot").isNull() & F.col(key).isNotNull()).drop("_hot").join(side.filter(F.col(count) <= least), key, how)
    return met.unionByName(others.select(*met.columns))


def crc32_of(column) -> F.Column:
    """Unsigned CRC-32 of a value's decimal text."""
    return F.crc32(F.encode(column.cast("string"), "UTF-8"))


def ascii_words(text: str | None) -> list[bytes]:
    """Words of bytes outside 0x20 and 0x09-0x0D, with A-Z lowered; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def stable_hash(data: bytes) -> int:
    """A 64-bit hash that is the same in every process."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")
