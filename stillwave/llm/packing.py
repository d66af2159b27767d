"""Packing of documents into training sequences: first-fit decreasing with a tournament
tree of bin capacities, run independently in randomised groups of documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from stillwave.llm import common
from stillwave.llm.bpe import byte_encoder

#: Documents in a group, on average; a group is one small task's work.
GROUP = 2048
LENGTH = 1024


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item: items in decreasing size (ties in order) go to the first bin
    with room. A node of the tournament tree holds the most room below it, so the first
    bin is found, and its path renewed, in as many steps as the tree is deep."""
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    room = [capacity] * (2 * leaves)
    bins = [0] * len(sizes)
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[item]
        if not 0 <= size <= capacity:
            raise ValueError(f"an item of {size} fits no bin of {capacity}")
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[item] = node - leaves
        room[node] -= size
        node >>= 1
        while node:
            room[node] = max(room[2 * node], room[2 * node + 1])
            node >>= 1
    return bins


def _mixed(x: int) -> int:
    """A pseudo-random 64-bit number from another."""
    x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (2**64 - 1)
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (2**64 - 1)
    return x ^ x >> 31


def pack(df: DataFrame, vocabulary: str, length: int = LENGTH, end: int = 0, group: int = GROUP, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row for each piece of a document: ``id``, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id`` and ``offset``.

    A document's ids are those of its text and then ``end``. It is cut into pieces of
    ``length`` ids, which fill a sequence each, and a rest, which shares one with the rests
    of other documents of its group. The group is a random number from the row's place in
    its input partition, the same when a lost task runs again; so rows that repeat an id
    don't meet in one group, and each row has pieces of its own. Only lengths and checksums
    are shuffled, never texts or ids.

    A null or empty text is the one id ``end``. An empty table gives an empty result. Other
    columns are left out. A text of any length is one row of the first step; its pieces
    need no more than its ids.
    """
    groups = max(1, round(df.count() / group))
    kind = df.schema[id].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(public_tokenizers.path(vocabulary))
        place, last = TaskContext.get().partitionId() << 40, end.to_bytes(4, "little")
        for batch in batches:
            tokens, sums, to = [], [], []
            for value in batch.column(1):
                ids = encoder.encode(value.as_py() or "") + last
                tokens.append(len(ids) // 4)
                sums.append([zlib.crc32(ids[i : i + 4 * length]) for i in range(0, len(ids), 4 * length)])
                to.append(_mixed(place) % groups)
                place += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens, pa.int64()), pa.array(sums, pa.list_(pa.int64())), pa.array(to, pa.int64())],
                ["id", "doc_tokens", "sums", "grp"],
            )

    def place(table: pa.Table) -> pa.Table:
        ids, grp = table.column("id"), table.column("grp")[0].as_py()
        tokens, sums = table.column("doc_tokens").to_pylist(), table.column("sums").to_pylist()
        rest = [t % length for t in tokens]
        items = [i for i, r in enumerate(rest) if r]
        bins = dict(zip(items, first_fit_decreasing([rest[i] for i in items], length), strict=True))
        filled: dict[int, int] = {}
        next_full = max(bins.values(), default=-1) + 1
        row: list[int] = []
        out: list[list[int]] = [[], [], [], [], []]
        for i, n in enumerate(tokens):
            for k, crc in enumerate(sums[i]):
                size = min(length, n - k * length)
                if size == length:
                    sequence, offset = next_full, 0
                    next_full += 1
                else:
                    sequence = bins[i]
                    offset = filled.get(sequence, 0)
                    filled[sequence] = offset + size
                row.append(i)
                for column, value in zip(out, (k * length, size, crc, (grp << 32) | sequence, offset), strict=True):
                    column.append(value)
        at = pa.array(row, pa.int64())
        return pa.table(
            [ids.take(at), *(pa.array(c, pa.int64()) for c in out[:3]), table.column("doc_tokens").take(at), *(pa.array(c, pa.int64()) for c in out[3:])],
            names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )

    rows = df.select(df[id], df[text].cast("string")).mapInArrow(encode, f"id {kind}, doc_tokens long, sums array<long>, grp long")
    out = rows.groupBy("grp").applyInArrow(place, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 ids."""
    return pack(common.documents(spark, sf_dir), "byte_bpe_50k.json")
