"""Exact duplicates by progressive refinement: rows are grouped by length, groups that are
left by a hash of their first characters, and only what shares both with another row has its
whole text hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwave.llm import common

#: Characters that the prefix hash reads.
PREFIX = 64
#: Words of 64 bits in the filter of surviving groups. It is sent to every task, so this
#: bounds its size; the more groups survive, the more texts are hashed beside theirs.
WORDS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _keyed(df: DataFrame, text: str, id: str, carry: Sequence[str]) -> DataFrame:
    """Length in bytes, which lower-casing A-Z doesn't change, and the hash of length and prefix."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    read = df.select(F.col(id).alias("_id"), value.alias("_text"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)))
    size = F.octet_length("_text").cast("long")
    head = F.translate(F.substring("_text", 1, PREFIX), UPPER, LOWER)
    return read.select("*", size.alias("_size"), F.xxhash64(size, head).alias("_key"))


def _filter(keys: DataFrame) -> DataFrame:
    """(``_word``, ``_bits``): at most WORDS rows, in which each key has one bit."""
    placed = keys.select(_word().alias("_word"), F.expr("shiftleft(1L, cast(_key & 63 as int))").alias("_bit"))
    return placed.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def _word() -> F.Column:
    return F.pmod(F.shiftright("_key", 6), F.lit(WORDS))


def groups(df: DataFrame, text: str = "text", id: str = "doc_id", carry: Sequence[str] = (), digests: bool = False) -> DataFrame:
    """One row for each row of ``df``: ``id``, the columns of ``carry``, ``keep_id``,
    ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when they are identical after lower-casing A-Z; null is as empty, and
    empty texts equal each other. Of equal texts the row of the largest id stays; a null id is
    smaller than any other, and among rows of one id and text exactly one stays, which of
    them is open. ``text_sha256`` is null for a text that was told from all others by length
    or prefix, unless ``digests`` asks for it. An empty table gives an empty result. Columns
    that aren't carried are left out, whatever their names. Texts of any length are compared
    whole.

    A first read takes lengths and prefix hashes; the counts of both are combined before they
    are shuffled. Surviving groups are marked in a filter of bounded size that is sent to the
    second read, which hashes the texts it lets through (those of survivors and, by chance,
    some others, for which the hash is work and nothing else). Texts are never shuffled, and
    groups of any size are counted, not gathered.
    """
    keyed = _keyed(df, text, id, carry)
    heads = common.written(keyed.select("_size", "_key"))
    total = heads.count()
    lengths = heads.groupBy("_size").agg(F.count("*").alias("_n")).filter("_n > 1")
    shared = common.join_hot(heads, lengths, "_size", "_n", total)
    survivors = shared.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n > 1").select("_key")
    names = [f"_c{i}" for i in range(len(carry))]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                hashlib.sha256(value.as_py().encode().lower()).hexdigest() if digests or passed.as_py() else None
                for value, passed in zip(batch.column("_text"), batch.column("_passed"), strict=True)
            ]
            rest = [i for i, name in enumerate(batch.schema.names) if name != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(found, pa.string())], [*(batch.schema.names[i] for i in rest), "_full"])

    met = keyed.withColumn("_word", _word()).join(F.broadcast(_filter(survivors)), "_word", "left")
    passed = F.coalesce(F.expr("_bits & shiftleft(1L, cast(_key & 63 as int))") != 0, F.lit(False))
    read = met.select("_id", *names, passed.alias("_passed"), "_text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read.schema if f.name != "_text")
    hashed = read.mapInArrow(digest, f"{schema}, _full string")
    rows = common.written(hashed.withColumn("_row", F.monotonically_increasing_id()))
    # A hash takes part in a group only if its row passed the filter; the rest are alone.
    apart = F.when(F.col("_passed"), F.col("_full"))
    best = F.max(F.struct("_id", "_row")).alias("_best")
    equal = rows.groupBy(apart.alias("_group")).agg(F.count("*").alias("_n"), best).filter("_group IS NOT NULL AND _n > 1")
    found = common.join_hot(rows.withColumn("_group", apart), equal, "_group", "_n", total, "left")
    keep = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_best._id"))
    return found.select(
        F.col("_id").alias(id), *(F.col(n).alias(c) for n, c in zip(names, carry, strict=True)), keep.alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_best._row") == F.col("_row"), F.lit(True)).alias("kept"), F.col("_full").alias("text_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the group of texts that each is equal to."""
    return groups(common.documents(spark, sf_dir), digests=True)


SQL = f"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
     grouped AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM lowered GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM lowered JOIN grouped USING (t)"""
