"""Exact top-k search by multi-resolution segment statistics.

A vector is cut into segments, few at first and then more, and each segment is told by its
mean and deviation. By the Cauchy-Schwarz inequality these bound a pair's distance from
below, |q - x|^2 >= sum of length * ((mean - mean')^2 + (dev - dev')^2), and with the norms
its inner product from above. Candidates whose bound falls short of the query's k-th exact
score so far are dropped, coarse to fine; the survivors' scores are exact.

Rows of like coarse statistics lie in one block, whose ranges of all statistics bound its
rows' scores together, so a query meets only the blocks whose bound reaches its bar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stillwave.llm import common, vectors

#: Segments by level.
LEVELS = (4, 16)
SCALE = 256
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Statistics of a vector at all levels, and bits of each coarse mean in a row's code.
WIDTH, BITS = 2 * sum(LEVELS), 4
CODES = 1 << BITS * LEVELS[0]
#: Groups of neighbouring blocks whose bounds are sent to every task (some 640 bytes each).
GROUPS = 10_000
#: Survivors' part of a block beyond which one matrix product is cheaper than their list.
DENSE = 0.25
#: Survivors of a query, on average, from which on its k-th score is looked for first.
MANY = 64
#: Pairs whose scores are computed at once from such a list.
PAIRS = 1 << 16


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Root length times mean and times deviation, by segment; a product of two vectors'
    statistics is the upper bound of their inner product."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1]))
    mean = np.stack([x[:, p].mean(1) for p in parts], 1)
    dev = np.stack([x[:, p].std(1) for p in parts], 1)
    root = np.sqrt([len(p) for p in parts])
    return np.concatenate([mean * root, dev * root], 1)


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 x), as doubles, which hold it exactly; infinite where a double can't."""
    with np.errstate(over="ignore"):
        return np.floor(SCALE * x)


def small(x: np.ndarray) -> np.ndarray:
    """Which whole vectors have components so small that a double holds the inner product of
    any two of them exactly."""
    return np.abs(x).max(1, initial=0) <= np.floor(np.sqrt(2.0**52 / max(1, x.shape[1])))


def exact_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of floor(256 x) of any doubles, as longs; one that no long can hold is
    the nearest long."""
    a, b = whole(q), whole(c)
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * q.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = lambda x: np.array([[int(v) * SCALE if abs(v) >= 2.0**53 else int(np.floor(SCALE * v)) for v in row] for row in x.tolist()], object)
    return np.clip(exact(q) @ exact(c).T, LEAST, MOST).astype(np.int64)


def code(x: np.ndarray) -> np.ndarray:
    """A number for each vector's direction in coarse means, whose bits take turns, so that
    near numbers are near in all of them."""
    mean = statistics(x, LEVELS[0])[:, : min(LEVELS[0], x.shape[1])]
    size = np.linalg.norm(x, axis=1, keepdims=True)
    step = np.clip((mean / np.where(size > 0, size, 1) + 1) * (1 << BITS - 1), 0, (1 << BITS) - 1).astype(np.int64)
    out = np.zeros(len(x), np.int64)
    for bit in reversed(range(BITS)):
        for s in range(step.shape[1]):
            out = 2 * out + (step[:, s] >> bit & 1)
    return out


def place(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row's cell, which is its dimension and whether it is small, and within it its code."""
    rows = whole(x)
    is_small = small(rows)
    codes = np.zeros(len(x), np.int64)
    codes[is_small] = code(rows[is_small])
    cell = 2 * x.shape[1] + ~is_small
    return np.ones(len(x), bool), np.stack([cell, cell * CODES + codes], 1)


def everywhere(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A query has no cell: ``visits`` says where it goes."""
    return np.ones(len(x), bool), np.empty((len(x), 0), np.int64)


def all_statistics(x: np.ndarray) -> np.ndarray:
    """The statistics at all levels side by side; short vectors have zeros behind theirs."""
    out = np.zeros((len(x), WIDTH))
    for level, start in zip(LEVELS, (0, 2 * LEVELS[0]), strict=True):
        some = statistics(x, level)
        out[:, start : start + some.shape[1]] = some
    return out


def matrix(column: pa.Array, dim: int, narrow: bool) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32 if narrow else np.float64).reshape(-1, dim).astype(np.float64)


def together(key: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple:
    """Counts and ranges of equal keys as one, in the keys' order."""
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    return key[order][starts], np.add.reduceat(n[order], starts), np.minimum.reduceat(lo[order], starts), np.maximum.reduceat(hi[order], starts)


def _joined(parts: list[tuple]) -> tuple:
    return together(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def _batch(key: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), *(pa.array([v.tobytes() for v in c], pa.binary()) for c in (lo, hi))], ["key", "n", "lo", "hi"])


def summed(df: DataFrame) -> DataFrame:
    """Rows of (``key``, ``n``, ``lo``, ``hi``), the last two the bytes of arrays of WIDTH
    doubles, with one row for each key. A task merges its sorted rows as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in (b for b in batches if b.num_rows):
            ranges = (np.frombuffer(b"".join(batch.column(c).to_pylist())).reshape(-1, WIDTH) for c in (2, 3))
            part = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), *ranges)
            part = _joined([part] if last is None else [last, part])
            last = tuple(c[-1:] for c in part)
            if len(part[0]) > 1:
                yield _batch(*(c[:-1] for c in part))
        if last is not None:
            yield _batch(*last)

    df = df.select("key", "n", "lo", "hi").repartition("key").sortWithinPartitions("key")
    return df.mapInArrow(run, "key long, n long, lo binary, hi binary")


def coded(rows: DataFrame, narrow: bool) -> DataFrame:
    """(``code``, ``cell``, ``n``, ``lo``, ``hi``): how many rows have a code, and the ranges
    of their statistics. Vectors that aren't small have none. Tasks add up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            dims, codes = batch.column("dim").to_numpy(), batch.column("code").to_numpy()
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == dim)
                x = whole(matrix(batch.column("x").take(pa.array(mine)), dim, narrow))
                is_small = small(x)
                values = np.zeros((len(x), WIDTH))
                values[is_small] = all_statistics(x[is_small])
                parts.append(together(codes[mine], np.ones(len(mine), np.int64), values, values))
                held += len(parts[-1][0])
            if held > CODES:
                parts = [_joined(parts)]
                held = len(parts[0][0])
                if held > CODES // 2:
                    yield _batch(*parts[0])
                    parts, held = [], 0
        if parts:
            yield _batch(*_joined(parts))

    found = summed(rows.select("dim", "code", "x").mapInArrow(run, "key long, n long, lo binary, hi binary"))
    return found.withColumnRenamed("key", "code").withColumn("cell", F.shiftright("code", BITS * LEVELS[0]))


def blocks_of(codes: DataFrame) -> DataFrame:
    """``codes`` with the blocks ``first`` to ``last`` of each: codes in order fill blocks of
    vectors.ROWS rows, of twice so many at most, and one of more rows is dealt to several."""
    earlier = Window.partitionBy("cell").orderBy("code").rowsBetween(Window.unboundedPreceding, -1)
    before, size = F.coalesce(F.sum("n").over(earlier), F.lit(0)), F.lit(vectors.ROWS)
    codes = codes.withColumn("before", before).withColumn("first", F.floor(F.col("before") / size).cast("int"))
    last = F.when(F.col("n") > size, F.floor((F.col("before") + F.col("n") - 1) / size).cast("int")).otherwise(F.col("first"))
    return codes.withColumn("last", last).drop("before")


def visits(asked: DataFrame, bounds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], narrow: bool, best: bool) -> DataFrame:
    """Each query with the (``cell``, ``grp``) that it must visit: groups of blocks whose
    bound reaches its bar or, with ``best``, the one of the highest bound. ``bounds`` has
    groups and their ranges for each cell; vectors that aren't small meet all."""
    sent = asked.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(s, vectors.QUERIES) for b in batches for s in range(0, b.num_rows, vectors.QUERIES)):
            dims = batch.column("dim").to_numpy()
            bars = batch.column("bar").fill_null(int(LEAST)).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                q = whole(matrix(batch.column("x").take(pa.array(at)), dim, narrow))
                plain = small(q)
                values = all_statistics(np.where(plain[:, None], q, 0))
                for cell in (2 * dim, 2 * dim + 1):
                    if cell not in sent.value:
                        continue
                    groups, lo, hi = sent.value[cell]
                    bound = np.full((len(q), len(groups)), np.inf)
                    if cell % 2 == 0:
                        for s, e in ((0, 2 * LEVELS[0]), (2 * LEVELS[0], WIDTH)):
                            v, low, high = values[:, s:e], lo[:, s:e], hi[:, s:e]
                            slack = 1e-9 * (np.abs(v) @ np.maximum(np.abs(low), np.abs(high)).T + 1)
                            bound = np.minimum(bound, np.maximum(v, 0) @ high.T + np.minimum(v, 0) @ low.T + slack)
                        bound[~plain] = np.inf
                    goes = np.arange(len(groups))[None] == bound.argmax(1)[:, None] if best else bound >= bars[at][:, None]
                    r, g = np.nonzero(goes)
                    ends = np.concatenate([[0], np.cumsum(goes.sum(1))]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(groups[g].astype(np.int32)))
                    few = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*(few.column(c) for c in ("uid", "id", "x", "bar")), pa.array(np.full(len(at), cell)), lists], ["uid", "id", "x", "bar", "cell", "groups"])

    out = asked.select("uid", "id", "dim", "x", "bar").mapInArrow(run, "uid long, id long, x binary, bar long, cell long, groups array<int>")
    return out.withColumn("grp", F.explode("groups")).drop("groups")


def bounded(q: np.ndarray, c: np.ndarray, levels: list[np.ndarray], alive: np.ndarray, bars: np.ndarray, k: int) -> np.ndarray:
    """Scores of all pairs of small vectors that can be among a query's k best, LEAST for the
    others and where ``alive`` is false to begin with."""
    slack = 1e-9 * (np.linalg.norm(q, axis=1).max(initial=0) * np.linalg.norm(c, axis=1).max(initial=0) + 1)
    scores, known, every = np.full(alive.shape, LEAST), np.zeros(alive.shape, bool), np.arange(len(q))[:, None]
    few, tops = min(k, alive.shape[1]), np.empty((len(q), 0), np.int64)
    for level, held in zip(LEVELS, levels, strict=True):
        bound = statistics(q, level) @ held.T + slack
        bound[~alive] = -np.inf
        # The k best bounds are computed first; the k-th exact score so far is the bar.
        first = np.argpartition(bound, alive.shape[1] - few, axis=1)[:, -few:]
        new = np.where(alive[every, first] & ~known[every, first], np.einsum("ij,ikj->ik", q, c[first]).astype(np.int64), LEAST)
        scores[every, first] = np.maximum(scores[every, first], new)
        known[every, first] = True
        tops = np.concatenate([tops, new], 1)
        if few == k:
            bars = np.maximum(bars, vectors.kth(tops, k))
        alive = alive & (bound >= bars[:, None])
    rest = alive & ~known
    if rest.mean() > DENSE:
        some = np.flatnonzero(rest.any(0))
        scores[:, some] = np.where(alive[:, some], (q @ c[some].T).astype(np.int64), scores[:, some])
    else:
        a, b = np.nonzero(rest)
        for s in range(0, len(a), PAIRS):
            i, j = a[s : s + PAIRS], b[s : s + PAIRS]
            scores[i, j] = np.einsum("ij,ij->i", q[i], c[j]).astype(np.int64)
    return np.where(scores >= bars[:, None], scores, LEAST)


def maker(k: int):
    def make(ids: np.ndarray, c: np.ndarray) -> vectors.Search:
        rows = whole(c)
        levels = [statistics(rows, level) for level in LEVELS] if small(rows).all() else None

        def search(q_ids: np.ndarray, q: np.ndarray, bars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            others = ids[None] != q_ids[:, None]
            asked = whole(q)
            scores = np.full(others.shape, LEAST)
            plain = small(asked) if levels else np.zeros(len(q), bool)
            if plain.any():
                scores[plain] = bounded(asked[plain], rows, levels, others[plain], bars[plain], k)
            if not plain.all():
                scores[~plain] = exact_products(q[~plain], c)
            valid = others & ((scores > LEAST) | ~plain[:, None])
            if valid.sum() > MANY * len(q):
                valid &= scores >= vectors.kth(np.where(valid, scores, LEAST), k)[:, None]
            r, at = np.nonzero(valid)
            found = scores[r, at]
            # In steps, since the least long has no negative.
            best = vectors.best_of(r, ids[at], np.maximum(found, LEAST + 1), k)
            return r[best], at[best], found[best]

        return search

    return make


def top_k(df: DataFrame, queries: DataFrame, k: int = 5, vector: str = "embedding", id: str = "vec_id") -> DataFrame:
    """(``query_id``, ``rank``, ``id``, ``score``): for each query the k rows of the largest
    inner product of floor(256 x), without its own id, ties to the smaller id.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do
    rows with a null id. Products of any size are exact; of a score that no long can hold the
    nearest long is returned, and such scores tie. Vectors of unequal length aren't compared.
    A query with fewer candidates has fewer rows; without queries or rows the result is empty.
    Rows that repeat an id are candidates each, and queries each, with ranks of their own.
    Other columns are left out.

    A query's k-th score in the block of the highest bound is the bar that it brings to all
    blocks whose bound reaches it. The driver gets the bounds of GROUPS groups of neighbouring
    blocks, or of one for each dimension if these are more.
    """
    narrow = vectors.single(df, queries, vector=vector)
    rows = vectors.located(df, id, vector, place, narrow)
    rows = rows.select("uid", "id", "dim", "x", F.col("cells")[0].alias("cell"), F.col("cells")[1].alias("code"))
    codes = common.cut(blocks_of(coded(rows, narrow)))
    total, most = codes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("last"), F.lit(0))).first()
    side, rows = codes.select("code", "cell", "first", "last", "n"), rows.drop("cell", "dim")
    # Four numbers a code: some megabytes at most where they are sent to every task.
    held = rows.join(F.broadcast(side), "code") if codes.count() <= vectors.CELLS else common.join_hot(rows, side, "code", "n", total)
    held = held.withColumn("block", F.col("first") + F.pmod(F.xxhash64("uid"), (F.col("last") - F.col("first") + 1).cast("long")).cast("int"))
    asked = common.cut(vectors.located(queries, id, vector, everywhere, narrow).drop("cells").withColumn("bar", F.lit(None).cast("long")))

    each = -(-(total // vectors.ROWS + 1) // GROUPS)
    spread = codes.withColumn("grp", F.explode(F.sequence(F.floor(F.col("first") / each), F.floor(F.col("last") / each))))
    bounds: dict[int, list] = {}
    for r in summed(spread.withColumn("key", F.shiftleft("cell", 31) + F.col("grp"))).collect():
        bounds.setdefault(r.key >> 31, []).append((r.key & (1 << 31) - 1, np.frombuffer(r.lo), np.frombuffer(r.hi)))
    bounds = {cell: tuple(np.array(c) for c in zip(*some, strict=True)) for cell, some in bounds.items()}

    def found(asked: DataFrame, best: bool) -> DataFrame:
        passing = visits(asked, bounds, narrow, best)
        inside = F.sequence(F.col("grp") * each, F.col("grp") * each + (0 if best else each - 1))
        return vectors.found(held, passing.withColumn("block", F.explode(inside)).drop("grp"), maker(k), "long", narrow)

    if most:
        bars = vectors.ranked(found(asked, True), k).filter(F.col("rank") == k).select(F.col("quid").alias("uid"), F.col("score").alias("bar"))
        asked = common.cut(asked.drop("bar").join(bars, "uid", "left"))
    return vectors.ranked(found(asked, False), k).select("query_id", "rank", F.col("id").alias(id), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for each vec_id that 50 divides."""
    rows = common.embeddings(spark, sf_dir)
    return top_k(rows, rows.filter(F.col("vec_id") % 50 == 0))


SQL = """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
                FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
     ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""
