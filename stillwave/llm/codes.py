"""Compression of vectors to product codes, with integer arithmetic throughout.

A vector is cut into parts; each position has a codebook of a few entries, which rounds of
assignment and averaging fit to all rows. The nearest entry is found by partial distances:
dimensions are added one by one, those in which the entries differ most first, and an entry
is dropped as soon as its sum strictly exceeds the best complete distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwave.llm import common

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Vectors whose distances are computed at once.
ROWS = 4096


def limit(dim: int) -> int:
    """The largest whole component for which a long holds any squared distance, and their
    sum over the vector."""
    return isqrt((1 << 61) // dim) // 2


def whole(df: DataFrame, vector: str, id: str, carry: tuple[str, ...], scale: int) -> DataFrame:
    """(``_id``, carried columns, ``_dim``, ``_v``): floor(scale * x) as bytes of longs, of rows
    whose vector is neither null nor empty and has only finite components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("_x")
            lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths[lengths > 0]).tolist():
                at = np.flatnonzero(lengths == dim)
                x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
                good = np.isfinite(x).all(1)  # a null became NaN
                at, x = at[good], x[good]
                most = limit(dim)
                with np.errstate(over="ignore"):
                    v = np.clip(np.floor(scale * x), -most, most).astype("<i8")
                rest = batch.take(pa.array(at)).drop_columns(["_x"])
                columns = [*rest.columns, pa.array(np.full(len(at), dim, np.int32)), pa.array([r.tobytes() for r in v], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*rest.schema.names, "_dim", "_v"])

    names = [F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)]
    read = df.select(F.col(id).alias("_id"), *names, F.col(vector).cast("array<double>").alias("_x"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read.schema if f.name != "_x")
    return read.mapInArrow(run, f"{schema}, _dim int, _v binary")


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each row, ties to the lower index, its squared distance, and the
    number of differences that were squared.

    Dimensions come in descending variance over the entries. The entry nearest in the first
    one is completed first, and gives the distance that the others must not exceed.
    """
    order = np.argsort(-book.astype(np.float64).var(0), kind="stable")
    x, book = x[:, order], book[:, order]
    total = (x[:, :1] - book[:, 0]) ** 2
    first, every = total.argmin(1), np.arange(len(x))
    best = ((x - book[first]) ** 2).sum(1)
    row, entry = np.nonzero(total <= best[:, None])
    sums, work = total[row, entry], x.size + total.size
    for d in range(1, x.shape[1]):
        sums = sums + (x[row, d] - book[entry, d]) ** 2
        work += len(sums)
        alive = sums <= best[row]
        row, entry, sums = row[alive], entry[alive], sums[alive]
    # Rows are in order and every row has its first entry left; the least (sum, entry) wins.
    at = np.lexsort((entry, sums, row))
    at = at[np.searchsorted(row[at], every)]
    return entry[at], sums[at], work


def assigned(v: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row by part: the nearest entries and their squared distances."""
    parts = v.reshape(len(v), books.shape[0], -1)
    found = [nearest(parts[:, p], books[p])[:2] for p in range(books.shape[0])]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for s in range(0, batch.num_rows, ROWS):
        few = batch.column("_v").slice(s, ROWS)
        yield s, np.frombuffer(b"".join(few.to_pylist()), "<i8").reshape(len(few), -1)


def _sums(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(``place``, ``n``, ``sums``): count and componentwise sums of what each entry of each part
    was assigned, added up in tasks and then by Spark."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(parts * entries, np.int64)
        # Sums are kept in two halves, so that no number of rows overflows a task's.
        high, low = np.zeros((2, parts * entries, width), np.int64)
        for batch in batches:
            for _, v in _blocks(batch):
                code, _ = assigned(v, books)
                cut = v.reshape(len(v), parts, width)
                for p in range(parts):
                    place = p * entries + code[:, p]
                    np.add.at(n, place, 1)
                    np.add.at(high, place, cut[:, p] >> 31)
                    np.add.at(low, place, cut[:, p] & (2**31 - 1))
        used = np.flatnonzero(n)
        for at in used:
            flat = np.concatenate([high[at], low[at]])
            yield pa.RecordBatch.from_arrays([pa.array([at] * 2 * width, pa.int64()), pa.array(range(2 * width), pa.int32()), pa.array(flat), pa.array([n[at]] * 2 * width, pa.int64())], ["place", "d", "s", "n"])

    partial = rows.select("_v").mapInArrow(run, "place long, d int, s long, n long")
    return partial.groupBy("place", "d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))


def _fitted(rows: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray | None:
    """The codebooks: part, entry, component."""
    first = rows.orderBy(F.col("_id").asc_nulls_last(), "_dim", "_v").select("_dim", "_v").limit(1).collect()
    if not first:
        return None
    dim = first[0]._dim
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    seeds = rows.filter(F.col("_dim") == dim).orderBy(F.col("_id").asc_nulls_last(), "_v").select("_v").limit(entries).collect()
    books = np.stack([np.frombuffer(bytes(r._v), "<i8").reshape(parts, -1) for r in seeds], 1).copy()
    fit = rows.filter(F.col("_dim") == dim)
    for _ in range(rounds):
        for r in _halves(_sums(fit, books).collect(), books.shape[2]):
            place, d, total, n = r
            books[place // books.shape[1], place % books.shape[1], d] = total // n
    return books


def _halves(rows: list, width: int) -> Iterator[tuple[int, int, int, int]]:
    """(place, component, sum, count) from the high and low halves of sums."""
    by = {(r.place, r.d): r for r in rows}
    for (place, d), r in by.items():
        if d < width:
            yield place, d, (int(r.s) << 31) + int(by[place, d + width].s), r.n


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vector: str = "embedding", id: str = "vec_id", carry: tuple[str, ...] = ()) -> tuple[DataFrame, np.ndarray | None]:
    """(``id``, the columns of ``carry``, ``code``, ``error``) for each row, and the codebooks.

    A component becomes floor(scale * x). Rows whose vector is null or empty, or holds a null
    or non-finite component, take no part, nor do rows whose vector is not as long as that of
    the smallest id. Components beyond what ``limit`` allows, whose distances no long holds,
    count as that limit. Codebooks start with the vectors of the smallest ids (ties by the
    vectors, null ids last; fewer rows give fewer entries), learn from all rows in each round,
    and an entry that none is nearest to stays as it is. ``code`` has two hex digits a part,
    ``error`` is the sum of squared distances. Repeated rows count and are coded each. Without
    rows the result is empty and there are no codebooks. Columns that aren't carried are left
    out, whatever their names.

    The driver holds the codebooks alone; a round sends it one row for each entry and
    component. The whole vectors are written once and reread by each round.
    """
    if entries > 256:
        raise ValueError("two hex digits hold 256 entries")
    rows = common.written(whole(df, vector, id, carry, scale))
    books = _fitted(rows, parts, entries, rounds)
    names = [f"_c{i}" for i in range(len(carry))]
    out = rows if books is None else rows.filter(F.col("_dim") == books.shape[0] * books.shape[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, v in _blocks(batch):
                code, error = assigned(v, books)
                rest = batch.slice(s, len(v)).drop_columns(["_v", "_dim"])
                found = [pa.array([r.tobytes().hex() for r in code.astype(np.uint8)]), pa.array(error.sum(1), pa.int64())]
                yield pa.RecordBatch.from_arrays([*rest.columns, *found], [*rest.schema.names, "code", "error"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("_v", "_dim"))
    coded = out.mapInArrow(run, f"{schema}, code string, error long")
    return coded.select(F.col("_id").alias(id), *(F.col(n).alias(c) for n, c in zip(names, carry, strict=True)), "code", "error"), books


def decode(codes: DataFrame, books: np.ndarray, scale: int = SCALE, code: str = "code", vector: str = "vector") -> DataFrame:
    """The same with the vectors that the codes stand for; a null code gives a null vector."""
    parts = books.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(code).to_pylist():
                at = None if value is None else np.frombuffer(bytes.fromhex(value), np.uint8)
                found.append(None if at is None else books[np.arange(parts), at].reshape(-1) / scale)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], [*batch.schema.names, vector])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema)
    return codes.mapInArrow(run, f"{schema}, `{vector}` array<double>")


def books_digest(books: np.ndarray | None) -> str:
    """SHA-256 of all entries' components by part, entry and place."""
    flat = [] if books is None else books.reshape(-1).tolist()
    return hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors' codes with their errors, and the errors of each label together."""
    codes, books = compress(common.embeddings(spark, sf_dir), carry=("label",))
    codes = common.written(codes.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))))
    labels = codes.groupBy("_label").agg(F.count("*").alias("_n"), F.sum("error").alias("label_error"))
    out = common.join_hot(codes, labels, "_label", "_n", codes.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The same in SQL, round by round."""
    nearest = """
     d{r} AS (SELECT x.vec_id, x.p, b.e, sum((x.x - b.x) * (x.x - b.x)) AS dist FROM x JOIN b{r} b ON b.p = x.p AND b.j = x.j GROUP BY x.vec_id, x.p, b.e),
     a{r} AS MATERIALIZED (SELECT vec_id, p, e, dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, p ORDER BY dist, e) AS k FROM d{r}) WHERE k = 1),"""
    update = """
     m{r} AS (SELECT x.p, a.e, x.j, CAST(sum(x.x) AS HUGEINT) AS s, count(*) AS n FROM x JOIN a{r} a ON a.vec_id = x.vec_id AND a.p = x.p GROUP BY x.p, a.e, x.j),
     b{n} AS MATERIALIZED (SELECT b.p, b.e, b.j, coalesce(CAST(s // n - CASE WHEN s < 0 AND s % n <> 0 THEN 1 ELSE 0 END AS BIGINT), b.x) AS x FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.e = b.e AND m.j = b.j),"""
    rounds = "".join(nearest.format(r=r) + update.format(r=r, n=r + 1) for r in range(ROUNDS)) + nearest.format(r=ROUNDS)
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
     x AS MATERIALIZED (SELECT vec_id, (i // (len(v) // {PARTS})) AS p, i % (len(v) // {PARTS}) AS j, v[i + 1] AS x FROM (SELECT vec_id, v, unnest(range(len(v))) AS i FROM kept)),
     seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})),
     b0 AS MATERIALIZED (SELECT p, e, j, x FROM x JOIN seeds USING (vec_id)),{rounds}
     codes AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
     digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes JOIN kept USING (vec_id), digest"""


SQL = _sql()
