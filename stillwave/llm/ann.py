"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by fast pseudo-rotations (random signs and a Hadamard transform,
three times) and hashed to the signed axis nearest to it. Every row is put into one bucket
of each of several tables; a query goes to the buckets of its nearest axes in each table,
and only there meets rows: they are its candidates, and their cosines are computed exactly.

How many tables there are, whether a bucket is told by one axis or by a pair of them, and how
many buckets a query probes is read off a bounded sample of queries and their true
neighbours: of all that reach the recall wanted there, the one with the least work is taken.
So vectors with structure, and large tables of them, have few candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stillwave.llm import common, vectors

#: Tables where the caller fixes the part of the buckets that a query probes.
TABLES = 4
#: The recall that a plan must reach on a sample of so many queries.
RECALL, SAMPLE = 0.95, 256
#: Numbers of tables to choose from, and buckets of a table up to which pairs of axes are tried.
CHOICES, PAIRED = (2, 3, 4, 6, 8), 1 << 16
#: Products of two vectors that cost as much as to send a vector to one more bucket.
COPY = 128
#: Pairs whose cosines are computed exactly at once.
PAIRS = 1 << 16
SEED = 20240302


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; a row is a power of two long."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotations(x: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """The rows under each table's pseudo-rotation: table, row, signed axes."""
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    padded = np.zeros((len(x), d))
    padded[:, : x.shape[1]] = x
    rng = np.random.default_rng([SEED, d])
    out = []
    for _ in range(tables):
        y = padded
        for _ in range(3):
            y = hadamard(y * rng.choice([-1.0, 1.0], d))
        out.append(np.concatenate([y, -y], 1))
    return np.stack(out)


def _unit(x: np.ndarray) -> np.ndarray:
    x = _tame(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _tame(x: np.ndarray) -> np.ndarray:
    """The same directions; vectors whose squares a double can't hold are scaled first."""
    largest = np.abs(x).max(1, keepdims=True)
    far = (largest > 1e100) | ((largest < 1e-100) & (largest > 0))
    return np.where(far, x / np.where(largest > 0, largest, 1), x)


class Plan(NamedTuple):
    """Axes that tell a bucket, tables, and buckets of each table that a query probes."""

    hashes: int
    tables: int
    probes: int


def _buckets(near: np.ndarray, plan: Plan) -> np.ndarray:
    """The bucket of each row, by table: its nearest axis, or the pair of them in two rotations."""
    axis = near[: plan.hashes * plan.tables].argmax(2).reshape(plan.tables, plan.hashes, -1)
    return axis[:, 0] if plan.hashes == 1 else axis[:, 0] * near.shape[2] + axis[:, 1]


def _closeness(near: np.ndarray, hashes: int, table: int) -> np.ndarray:
    """How close each row is to each of a table's buckets."""
    if hashes == 1:
        return near[table]
    return (near[2 * table][:, :, None] + near[2 * table + 1][:, None, :]).reshape(near.shape[1], -1)


def dealer(plan_of: Callable[[int], Plan | None], asked: bool) -> vectors.Place:
    """Cells of each vector: the buckets that it lies in or, if ``asked``, those it probes.
    Vectors of a dimension without a plan share one cell."""

    def deal(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kept = x.any(1)
        x, dim = x[kept], x.shape[1]
        plan = plan_of(dim)
        if plan is None:
            return kept, np.full((len(x), 1), dim << 32)
        out = [np.empty((0, plan.tables * (plan.probes if asked else 1)), np.int64)]
        for s in range(0, len(x), vectors.QUERIES):
            near = rotations(_unit(x[s : s + vectors.QUERIES]), plan.hashes * plan.tables)
            if asked:
                parts = [np.argpartition(-_closeness(near, plan.hashes, t), plan.probes - 1, axis=1)[:, : plan.probes] for t in range(plan.tables)]
            else:
                parts = list(_buckets(near, plan)[:, :, None])
            out.append(np.concatenate([(dim << 32) + (t << 26) + part for t, part in enumerate(parts)], 1))
        return kept, np.concatenate(out)

    return deal


def _axes(dim: int) -> int:
    return 2 << max(0, dim - 1).bit_length()


def placer(tables: int, probed: float | None) -> vectors.Place:
    """The same for buckets of one axis: a row's own or, if ``probed``, that part of all."""
    return dealer(lambda dim: Plan(1, tables, max(1, min(_axes(dim), round(_axes(dim) * (probed or 0))))), probed is not None)


def chosen(q: np.ndarray, x: np.ndarray, rows: int, queries: int) -> Plan:
    """The plan of the least work that finds RECALL of the pairs of a query and a true
    neighbour: with so many tables, a pair needs as many probes as the neighbour's bucket
    has places in the query's order, in the best of them."""
    axes, q, x = _axes(q.shape[1]), _unit(q), _unit(x)
    plans = []
    for hashes in (1, 2) if axes * axes <= PAIRED else (1,):
        near_q, near_x = rotations(q, hashes * CHOICES[-1]), rotations(x, hashes * CHOICES[-1])
        lies = _buckets(near_x, Plan(hashes, CHOICES[-1], 1))
        places = np.empty(lies.shape, np.int64)
        for t in range(CHOICES[-1]):
            for s in range(0, len(q), vectors.QUERIES):
                close = _closeness(near_q[:, s : s + vectors.QUERIES], hashes, t)
                own = lies[t, s : s + vectors.QUERIES]
                places[t, s : s + vectors.QUERIES] = (close >= close[np.arange(len(own)), own][:, None]).sum(1)
        for tables in CHOICES:
            needed = np.sort(places[:tables].min(0))
            probes = int(needed[int(np.ceil(RECALL * len(needed))) - 1])
            work = tables * (probes * (rows / axes**hashes + COPY) + COPY * rows / max(1, queries))
            plans.append((work, Plan(hashes, tables, probes)))
    return min(plans)[1]


def calibrated(rows: DataFrame, asked: DataFrame, k: int, narrow: bool, n_rows: int, n_queries: int) -> dict[int, Plan]:
    """A plan for each dimension of which a sample of SAMPLE queries, those of the smallest
    hashes, has neighbours. Their k true ones are found in one pass over the rows, to which
    the sample's vectors are sent; what reaches the driver is k vectors for each at most."""
    width = np.float32 if narrow else np.float64
    matrix = lambda parts, dim: np.frombuffer(b"".join(parts), width).reshape(-1, dim).astype(np.float64)
    by_dim: dict[int, list] = {}
    for r in asked.orderBy(F.xxhash64("id", "x"), "id", "uid").limit(SAMPLE).collect():
        by_dim.setdefault(r.dim, []).append(r)
    sampled = {dim: (np.array([r.id for r in some]), matrix([r.x for r in some], dim)) for dim, some in by_dim.items()}
    sent = rows.sparkSession.sparkContext.broadcast(sampled)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for batch in batches:
            dims, ids = batch.column("dim").to_numpy(), batch.column("id").to_numpy()
            for dim in np.intersect1d(dims, list(sent.value)).tolist():
                (q_ids, q), mine = sent.value[dim], np.flatnonzero(dims == dim)
                x = matrix(batch.column("x").take(pa.array(mine)).to_pylist(), dim)
                r, at, scores = maker(k)(ids[mine], x)(q_ids, q, np.full(len(q), -np.inf))
                new = (r, ids[mine][at], scores, x[at])
                both = [np.concatenate(c) for c in zip(best[dim], new, strict=True)] if dim in best else new
                kept = vectors.best_of(both[0], both[1], both[2], k)
                best[dim] = tuple(c[kept] for c in both)
        for dim, (r, ids, scores, x) in best.items():
            columns = [pa.array(np.full(len(r), dim, np.int32)), pa.array(r.astype(np.int64)), pa.array(ids), pa.array(scores), pa.array([v.astype(width).tobytes() for v in x], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["dim", "r", "id", "score", "x"])

    found = rows.select("id", "dim", "x").mapInArrow(scan, "dim int, r long, id long, score double, x binary")
    order = Window.partitionBy("dim", "r").orderBy(F.desc("score"), "id", "x")
    pairs: dict[int, list] = {}
    for p in found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).collect():
        pairs.setdefault(p.dim, []).append(p)
    sent.unpersist()
    return {dim: chosen(sampled[dim][1][[p.r for p in some]], matrix([p.x for p in some], dim), n_rows, n_queries) for dim, some in pairs.items()}


def maker(k: int):
    def make(ids: np.ndarray, c: np.ndarray) -> vectors.Search:
        c = _tame(c)
        size = np.sqrt((c * c).sum(1))
        unit = c / size[:, None]

        def search(q_ids: np.ndarray, q: np.ndarray, bars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            q = _tame(q)
            q_size = np.sqrt((q * q).sum(1))
            scores = (q / q_size[:, None]) @ unit.T
            scores[ids[None] == q_ids[:, None]] = -np.inf
            # A product of matrices may round equal pairs apart; row sums don't.
            r, at = np.nonzero((scores >= vectors.kth(scores, k)[:, None] - 1e-12) & (scores > -np.inf))
            exact = np.empty(len(r))
            for s in range(0, len(r), PAIRS):
                a, b = r[s : s + PAIRS], at[s : s + PAIRS]
                exact[s : s + PAIRS] = (q[a] * c[b]).sum(1) / (q_size[a] * size[b])
            best = vectors.best_of(r, ids[at], exact, k)
            return r[best], at[best], exact[best]

        return search

    return make


def nearest(
    df: DataFrame, queries: DataFrame, k: int = 5, tables: int = TABLES, probed: float | None = None, vector: str = "embedding", id: str = "vec_id"
) -> DataFrame:
    """(``query_id``, ``rank``, ``id``, ``score``): for each query the k rows of the largest
    cosine among its candidates, without its own id, ties to the smaller id.

    Candidates are the rows in the buckets that the query probes: as many as ``calibrated``
    finds fit or, with ``probed``, that part of the buckets of ``tables`` tables. A query that
    finds fewer than k there, as in small tables, and one of a dimension that the sample lacks
    meets all rows.
    Vectors that are null, empty, zero, or hold null or non-finite components take no part,
    nor do rows with a null id. Vectors of unequal length aren't compared. Without queries or
    rows the result is empty. Rows that repeat an id are candidates each, and queries each,
    with ranks of their own. Other columns are left out. ``probed`` of 1 makes every row a
    candidate and the result exact.
    """
    narrow = vectors.single(df, queries, vector=vector)
    everywhere = dealer(lambda dim: None, False)
    every = vectors.located(df, id, vector, everywhere, narrow)
    if probed is None:
        plans = calibrated(every, vectors.located(queries, id, vector, everywhere, narrow), k, narrow, df.count(), queries.count())
        deal, ask = dealer(plans.get, False), dealer(plans.get, True)
    else:
        deal, ask = placer(tables, None), placer(tables, probed)
    rows = vectors.located(df, id, vector, deal, narrow)
    asked = common.cut(vectors.located(queries, id, vector, ask, narrow).withColumn("bar", F.lit(None).cast("double")))
    found = common.cut(vectors.ranked(vectors.meet(rows, asked, vectors.blocks(rows), maker(k), "double", narrow), k))
    whole = found.groupBy("quid").count().filter(F.col("count") >= k).select(F.col("quid").alias("uid"))
    short = asked.join(whole, "uid", "left_anti")
    if not short.isEmpty():
        one = short.withColumn("cells", F.array(F.shiftleft(F.col("dim").cast("long"), 32)))
        exact = vectors.ranked(vectors.meet(every, one, vectors.blocks(every), maker(k), "double", narrow), k)
        found = found.join(short.select(F.col("uid").alias("quid")), "quid", "left_anti").select(*exact.columns).unionByName(exact)
    return found.select("query_id", "rank", F.col("id").alias(id), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows found for each vec_id that 50 divides."""
    rows = common.embeddings(spark, sf_dir)
    return nearest(rows, rows.filter(F.col("vec_id") % 50 == 0))
