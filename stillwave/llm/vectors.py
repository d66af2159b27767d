"""Vectors dealt to cells, and a stated query set that meets the rows of its cells block by
block. The exact search has one cell for each kind of vector, hashing has one for each bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from stillwave.llm import common

#: Rows in a block, on average, and queries that are scored at once; both bound a task's memory.
ROWS, QUERIES = 16_384, 256
#: Cells up to which their table of counts is sent to every task; it is joined beyond.
CELLS = 100_000
#: Turns a matrix of doubles into which rows to keep, and the cells of those kept.
Place = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
#: From a batch of queries' ids, matrix and bars: places of queries and of rows, and scores.
Search = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
Make = Callable[[np.ndarray, np.ndarray], Search]


def single(*frames: DataFrame, vector: str) -> bool:
    """Whether the vectors of all frames are of single precision, and may travel as such."""
    kinds = [df.schema[vector].dataType for df in frames]
    return all(isinstance(k, ArrayType) and isinstance(k.elementType, FloatType) for k in kinds)


def located(df: DataFrame, id: str, vector: str, place: Place, narrow: bool) -> DataFrame:
    """Vectors with their cells: ``uid`` (of the row), ``id``, ``dim``, ``cells`` and ``x``,
    the components' bytes. Vectors that are null, empty or hold a null or non-finite
    component are left out, and rows with a null id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
            lengths = np.where(ids.is_valid().to_numpy(zero_copy_only=False), lengths, 0)
            for dim in np.unique(lengths[lengths > 0]).tolist():
                at = np.flatnonzero(lengths == dim)
                x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                good = np.isfinite(x).all(1)  # a null became NaN
                at, x = at[good], x[good]
                kept, cells = place(x.astype(np.float64))
                at, x = at[kept], x[kept]
                if len(at):
                    ends = np.arange(len(at) + 1, dtype=np.int32) * cells.shape[1]
                    columns = [
                        pa.array(uid + at), ids.take(pa.array(at)), pa.array(np.full(len(at), dim, np.int32)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(cells.reshape(-1).astype(np.int64))), pa.array([v.tobytes() for v in x], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["uid", "id", "dim", "cells", "x"])
            uid += batch.num_rows

    values = F.col(vector).cast("array<float>" if narrow else "array<double>")
    return df.select(F.col(id).cast("long"), values).mapInArrow(run, "uid long, id long, dim int, cells array<long>, x binary")


def blocks(rows: DataFrame) -> DataFrame:
    """(``cell``, ``blocks``): the blocks of about ROWS rows that a cell's rows are dealt to."""
    counted = rows.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    return common.cut(counted.select("cell", F.ceil(F.col("n") / F.lit(ROWS)).cast("int").alias("blocks")))


def meet(rows: DataFrame, asked: DataFrame, counts: DataFrame, make: Make, score: str, narrow: bool) -> DataFrame:
    """What ``found`` gives for rows that are dealt to one block of each of their cells, and
    queries that go to all blocks of the cells they ask for."""
    if counts.count() <= CELLS:
        counts = F.broadcast(counts)
    held = rows.select("uid", "id", "x", F.explode("cells").alias("cell")).join(counts, "cell")
    held = held.withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks").cast("long")).cast("int"))
    passing = asked.select("uid", "id", "x", "bar", F.explode("cells").alias("cell")).join(counts, "cell")
    return found(held, passing.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), make, score, narrow)


def found(held: DataFrame, passing: DataFrame, make: Make, score: str, narrow: bool) -> DataFrame:
    """(``quid``, ``query_id``, ``uid``, ``id``, ``score``): what ``make(ids, matrix)``, built
    once for every block of the rows in ``held``, finds for the queries that pass by it.

    A task holds one block and lets the queries pass by, so memory is bounded however many
    rows or queries a cell has, and a large cell is as many tasks as blocks.
    """
    columns = ["cell", "block", "kind", "uid", "id", "bar", "x"]
    both = held.withColumns({"kind": F.lit(0), "bar": F.lit(None).cast(score)}).select(*columns)
    both = both.unionByName(passing.withColumn("kind", F.lit(1)).select(*columns))
    both = both.repartition("cell", "block").sortWithinPartitions("cell", "block", "kind")
    least = np.iinfo(np.int64).min if score == "long" else -np.inf
    width, numbers = np.float32 if narrow else np.float64, pa.int64() if score == "long" else pa.float64()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(starts, starts[1:], strict=False):
                if e > s:
                    yield tuple(keys[:, s].tolist()), batch.slice(s, e - s)

    def read(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.frombuffer(b"".join(part.column("x").to_pylist()), width).reshape(part.num_rows, -1)
        return part.column("uid").to_numpy(), part.column("id").to_numpy(), x.astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, search = None, [], None
        for (cell, number, kind), part in parts(batches):
            if (cell, number) != key:
                key, block, search = (cell, number), [], None
            if kind == 0:  # the rows come first
                block.append(read(part))
                continue
            if not block:
                continue
            if search is None:
                uids, ids, x = (np.concatenate(c) for c in zip(*block, strict=True))
                search = make(ids, x)
            for s in range(0, part.num_rows, QUERIES):
                few = part.slice(s, QUERIES)
                q_uids, q_ids, q = read(few)
                bars = few.column("bar").fill_null(least).to_numpy(zero_copy_only=False)
                r, at, scores = search(q_ids, q, bars)
                out = [pa.array(c, pa.int64()) for c in (q_uids[r], q_ids[r], uids[at], ids[at])]
                yield pa.RecordBatch.from_arrays([*out, pa.array(scores, numbers)], ["quid", "query_id", "uid", "id", "score"])

    return both.mapInArrow(run, f"quid long, query_id long, uid long, id long, score {score}")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """Each query row's ``k`` best with their ``rank``, ties to the smaller id; a row that
    was found in several cells counts once."""
    best = Window.partitionBy("quid").orderBy(F.desc("score"), "id", "uid")
    return found.withColumn("rank", F.dense_rank().over(best).cast("int")).filter(F.col("rank") <= k).dropDuplicates(["quid", "rank"])


def best_of(r: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query r, ties to the smaller id."""
    order = np.lexsort((ids, -scores, r))
    r = r[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return order[place < k]


def kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, or the least of them if there are fewer."""
    at = max(0, scores.shape[1] - k)
    return np.partition(scores, at, axis=1)[:, at]
