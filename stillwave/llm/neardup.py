"""Near-duplicates by MinHash: many universal hash minima with banding, signature
verification, an exact check on full sets, and components by alternating large-star and
small-star.

1. Every text gets the set of its word shingles, the minima of many universal hash
   functions over the set, and a fingerprint of the set. Texts of one set are one class.
2. Classes that agree in a band of minima share a bucket. Inside a bucket, signatures are
   compared from each class to those not yet reached, and every group that hangs together
   at the verified similarity gives a star of links, one fewer than it has members, however
   many of its pairs are alike.
3. The components of these links are candidate groups: each true link lies within one.
4. The texts of a candidate group meet once. Exact similarities of full sets decide, and
   again stars are kept, so that no link between different texts is lost and no group is
   ever expanded into its pairs.

Buckets and groups beyond a bound are dealt out in pairs of blocks, so that every pair of
members still meets in some task, and a task's memory stays bounded.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwave.llm import common
from stillwave.llm.components import connected_components

#: Minima in a band; the number of bands follows from MISS.
ROWS = 4
#: A link at exactly the threshold is missed by all bands with at most this probability.
MISS = 1e-6
#: Standard errors below the threshold at which a signature still counts as alike.
ERRORS = 5.0
#: Classes of a bucket, and classes and shingles of a candidate group, in one block.
BUCKET_BLOCK, GROUP_BLOCK, GROUP_SHINGLES = 4096, 2048, 4_000_000
#: Shingles hashed at once.
BLOCK = 2048

_ODD = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: int) -> int:
    return max(1, math.ceil(math.log(MISS) / math.log(1 - (threshold / 100) ** ROWS)))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; of fewer words, one hash of
    the whole sequence; of no words, none."""
    words = common.ascii_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)
    k = min(k, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + len(out)]) * _ODD
        out ^= out >> np.uint64(32)
    return np.unique(out)


class Minima:
    """Universal hash functions (a x + b), one row of a and b for each minimum."""

    def __init__(self, bands: int):
        rng = np.random.default_rng(20240301)
        n = bands * ROWS
        self.bands = bands
        self.a = rng.integers(0, 2**64, (n, 1), dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 2**64, (n, 1), dtype=np.uint64)

    def __call__(self, found: np.ndarray) -> tuple[bytes, list[int]]:
        """A byte of each minimum, and the hash of each band."""
        x = found >> np.uint64(32)
        least = None
        for i in range(0, len(x), BLOCK):
            h = x[i : i + BLOCK] * self.a
            h += self.b
            m = h.min(1)
            least = m if least is None else np.minimum(least, m)
        least >>= np.uint64(20)
        band = np.arange(1, self.bands + 1, dtype=np.uint64)
        for column in least.reshape(self.bands, ROWS).T:
            band = (band ^ column) * _ODD
            band ^= band >> np.uint64(29)
        return (least & np.uint64(255)).astype(np.uint8).tobytes(), band.astype(np.int64).tolist()


def need(threshold: int, minima: int) -> int:
    """Agreeing bytes of a signature at which a pair still counts as alike."""
    s = threshold / 100
    return math.floor((s - ERRORS * math.sqrt(s * (1 - s) / minima)) * minima)


def hang_together(size: int, alike) -> Iterator[list[int]]:
    """Groups of more than one among ``size`` items, where ``alike(x, rest)`` tells which
    of the rest are linked with x. Each item is compared with those not yet reached."""
    rest = np.arange(size)
    while len(rest) > 1:
        group, front, rest = [int(rest[0])], [int(rest[0])], rest[1:]
        while front and len(rest):
            near = alike(front.pop(), rest)
            if near.any():
                reached = rest[near].tolist()
                group += reached
                front += reached
                rest = rest[~near]
        if len(group) > 1:
            yield group


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows with equal first columns, which the input is sorted by."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for s, e in zip(starts, starts[1:], strict=False):
            key = tuple(c[s] for c in columns)
            if waiting and key != last:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(s, e - s))
            last = key
    if waiting:
        yield pa.Table.from_batches(waiting)


class Links:
    """Collects stars of links and gives them out in batches."""

    def __init__(self):
        self.a: list[int] = []
        self.b: list[int] = []

    def star(self, members: list[int]) -> None:
        low = min(members)
        for m in members:
            if m != low:
                self.a.append(m)
                self.b.append(low)

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        if len(self.a) >= least and self.a:
            yield pa.RecordBatch.from_arrays([pa.array(self.a, pa.int64()), pa.array(self.b, pa.int64())], ["a", "b"])
            self.a, self.b = [], []


def _signatures(docs: DataFrame, k: int, bands: int) -> DataFrame:
    """Each row's number, id, text hash, and what its set of shingles tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima, uid = Minima(bands), TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column(2):
                found = shingles(text.as_py(), k)
                values = (len(found), None, None, None)
                if len(found):
                    values = (len(found), fingerprint(found), *minima(found))
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(uid, uid + batch.num_rows)), batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))],
                ["uid", "id", "t", "n", "fp", "sig", "bands"],
            )
            uid += batch.num_rows

    return docs.mapInArrow(run, "uid long, id long, t long, n long, fp binary, sig binary, bands array<long>")


def fingerprint(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _blocks(rows: DataFrame, by: str, count: str, id: str) -> DataFrame:
    """Rows of a large group, once for each pair of blocks that holds their block; columns
    i and j name the pair."""
    block = F.pmod(F.xxhash64(id), F.col(count)).cast("int")
    rows = rows.withColumn("_block", block).withColumn("_other", F.explode(F.sequence(F.lit(0), (F.col(count) - 1).cast("int"))))
    return rows.withColumn("i", F.least("_block", "_other")).withColumn("j", F.greatest("_block", "_other"))


def classes_of(df: DataFrame, k: int, threshold: int, text: str, id: str, by_id: bool) -> tuple[DataFrame, DataFrame, int, DataFrame | None]:
    """Rows (``uid``, ``id``, ``t``, ``n``, ``fp``), a table (``fp``, ``component``, ``low``,
    ``c``) of their classes, the number of rows, and :func:`_repeated` ids.

    A class is the rows of one set; ``fp`` is null for empty sets, which have no class. ``c``
    counts the class's rows, ``component`` names what it hangs together with, over links and,
    with ``by_id``, over rows of one id, and ``low`` is the smallest id in there. ``t`` is a
    hash of the text. Rows without an id have a class of their own nowhere: they take no part.
    """
    bands = bands_for(threshold)
    least = need(threshold, bands * ROWS)
    docs = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    rows = common.cut(_signatures(docs.select("id", "t", "text"), k, bands))
    total, repeated = rows.count(), _repeated(rows)
    some = rows.filter("n > 0 and id is not null")
    # Of a class the row of the smallest id stands for all. Where no id repeats it names the
    # class, so that the smallest node of a component is its smallest id.
    first = F.min(F.struct("id", "uid", "t", "n", "sig", "bands")).alias("s")
    classes = some.groupBy("fp").agg(first, F.count("*").alias("c")).select("fp", "c", "s.*")
    classes = common.cut(classes if repeated is not None else classes.withColumn("uid", F.col("id")))

    def alike_by_signature(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
        links = Links()
        for table in runs(batches, keys):
            ids = table.column("uid").to_numpy()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
            for group in hang_together(len(ids), lambda x, rest, sig=sig: (sig[rest] == sig[x]).sum(1) >= least):
                links.star(ids[group].tolist())
            yield from links.batches(10_000)
        yield from links.batches(1)

    buckets = classes.select("uid", F.explode("bands").alias("bucket"))
    counts = buckets.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1")
    shared = common.join_hot(buckets, counts, "bucket", "c", bands * total)
    shared = common.cut(shared.join(classes.select("uid", "sig"), "uid").select("bucket", "c", "uid", "sig"))
    alone = shared.filter(F.col("c") <= BUCKET_BLOCK).repartition("bucket").sortWithinPartitions("bucket")
    large = shared.filter(F.col("c") > BUCKET_BLOCK).withColumn("blocks", F.ceil(F.col("c") / BUCKET_BLOCK))
    large = _blocks(large, "bucket", "blocks", "uid").select("bucket", "i", "j", "uid", "sig")
    large = large.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    candidates = alone.select("bucket", "uid", "sig").mapInArrow(lambda b: alike_by_signature(b, 1), "a long, b long").unionByName(
        large.mapInArrow(lambda b: alike_by_signature(b, 3), "a long, b long")
    )

    groups = connected_components(candidates).withColumnRenamed("node", "uid")
    members = common.cut(groups.join(classes.select("uid", "id", "t", "n", "fp"), "uid"))
    totals = members.groupBy("component").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    totals = totals.withColumn("blocks", F.greatest(F.ceil(F.col("c") / GROUP_BLOCK), F.ceil(F.col("s") / GROUP_SHINGLES)))
    placed = common.join_hot(members, totals, "component", "c", total)
    columns = ["component", "i", "j", "uid", "id", "t", "fp"]
    dealt = (
        placed.filter("blocks = 1").withColumns({"i": F.lit(0), "j": F.lit(0)}).select(*columns)
        .unionByName(_blocks(placed.filter("blocks > 1"), "component", "blocks", "uid").select(*columns))
    )

    def alike_by_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = Links()
        for table in runs(batches, 3):
            sets: dict[int, np.ndarray] = {}
            for uid, fp, value in zip(*(table.column(c) for c in ("uid", "fp", "text")), strict=True):
                if uid.as_py() not in sets and fingerprint(found := shingles(value.as_py(), k)) == fp.as_py():
                    sets[uid.as_py()] = found
            ids = np.array(list(sets), np.int64)
            if len(ids) > 1:
                for group in hang_together(len(ids), _Exact(list(sets.values()), threshold)):
                    links.star(ids[group].tolist())
            yield from links.batches(10_000)
        yield from links.batches(1)

    met = dealt.join(docs.filter("id is not null"), ["id", "t"]).select("component", "i", "j", "uid", "fp", "text")
    edges = []
    if repeated is not None:
        met = met.dropDuplicates(["component", "i", "j", "uid"])
    met = met.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    links = common.cut(met.mapInArrow(alike_by_sets, "a long, b long"))
    if by_id and repeated is not None:
        # Classes with rows of one id are linked with the first of these classes.
        several = some.select("id", "fp").join(repeated.filter("several").select("id"), "id").distinct()
        several = several.join(classes.select("fp", "uid"), "fp").select("id", F.col("uid").alias("a"))
        edges = [several.join(several.groupBy("id").agg(F.min("a").alias("b")), "id").select("a", "b")]
    if not edges and totals.filter("blocks > 1").isEmpty():  # then every star is a whole component
        found = links.select(F.col("a").alias("uid"), F.col("b").alias("component")).distinct()
        found = found.unionByName(found.select(F.col("component").alias("uid"), "component").distinct())
    else:
        found = connected_components(links.unionByName(*edges) if edges else links).withColumnRenamed("node", "uid")
    if repeated is None:
        found = found.withColumn("low", F.col("component"))
    else:
        found = common.cut(found.join(classes.select("uid", "id"), "uid"))
        low = found.groupBy("component").agg(F.min("id").alias("low"), F.count("*").alias("m"))
        found = common.join_hot(found.select("uid", "component"), low, "component", "m", total).select("uid", "component", "low")
    table = classes.select("fp", "c", "uid", "id").join(found, "uid", "left")
    table = table.select("fp", F.coalesce("component", "uid").alias("component"), F.coalesce("low", "id").alias("low"), "c")
    return rows.select("uid", "id", "t", "n", "fp"), table, total, repeated


def _repeated(rows: DataFrame) -> DataFrame | None:
    """Ids of more than one row, and whether these have ``several`` sets; None if there are
    no such ids."""
    by_id = rows.filter("id is not null").groupBy("id").agg(F.count("*").alias("c"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    found = common.cut(by_id.filter("c > 1").select("id", (F.col("a") != F.col("b")).alias("several")))
    return None if found.isEmpty() else found


def near_duplicates(df: DataFrame, k: int = 5, threshold: int = 80, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row for each row of ``df``: ``id``, ``n_shingles`` (size of the set of distinct
    k-word shingles), ``component_id`` (the smallest id reachable over links, its own
    included) and ``kept`` (whether that is its own id).

    Texts whose sets have 100 * intersection >= threshold * union are linked. Words are runs
    of bytes outside 0x20 and 0x09-0x0D, with A-Z lowered. Texts of fewer than k words have
    their whole sequence as the one shingle. A null text or one without words has an empty
    set and is linked with nothing. A row whose id is null takes no part: its component is
    null and it is kept. Rows that repeat an id are one node, whatever their texts: what one
    of them is linked with, all are. An empty table gives an empty result; other columns are
    left out. Texts of any length are taken whole.
    """
    rows, table, total, repeated = classes_of(df, k, threshold, text, id, by_id=True)
    out = common.join_hot(rows.withColumn("fp", F.when(F.col("id").isNotNull(), F.col("fp"))), table.select("fp", "low", "c"), "fp", "c", total, "left")
    if repeated is None:
        out = out.withColumn("also", F.lit(None).cast("long"))
    else:
        # Rows without words whose id also has a row with some: few, if any.
        empty = out.filter("n = 0 and id is not null").select("id").distinct()
        also = out.filter("n > 0").join(empty, "id", "left_semi").groupBy("id").agg(F.min("low").alias("also"))
        out = out.join(also, "id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("low", "also", "id"))
    return out.select(
        F.col("id").alias(id),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def keep_first(df: DataFrame, k: int = 5, threshold: int = 80, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows of ``df`` with all their columns, of each group of texts that hangs together
    one: that of the smallest id, and among rows of this id that of the smallest text hash.

    Links are those of :func:`near_duplicates`, but rows are judged each by its own text:
    rows that repeat an id go together only if their texts do. Rows whose id is null, and
    texts without words, all stay. An empty table gives an empty result.
    """
    rows, table, total, _ = classes_of(df, k, threshold, text, id, by_id=False)
    rows = common.join_hot(rows.filter("n > 0 and id is not null"), table.select("fp", "component", "c"), "fp", "c", total)
    first = rows.groupBy("component").agg(F.min(F.struct("id", "t")).alias("first"), F.count("*").alias("m")).filter("m > 1")
    groups = common.cut(common.join_hot(rows.select("component", "id", "t"), first, "component", "m", total))
    gone = groups.filter(F.struct("id", "t") != F.col("first")).select(F.col("id").alias("_id"), F.col("t").alias("_t")).distinct()
    key = "_id_and_text_hash"
    keyed = df.withColumn(key, F.struct(F.col(id).cast("long").alias("_id"), F.xxhash64(F.col(text).cast("string")).alias("_t")))
    left = keyed.join(gone.select(F.struct("_id", "_t").alias(key)), key, "left_anti")
    # The first row itself may stand there more than once.
    again = groups.filter(F.struct("id", "t") == F.col("first")).groupBy("id", "t").count().filter("count > 1")
    again = common.cut(again.select(F.struct(F.col("id").alias("_id"), F.col("t").alias("_t")).alias(key)))
    if again.isEmpty():
        return left.select(*df.columns)
    return left.join(again, key, "left_anti").unionByName(left.join(again, key, "left_semi").dropDuplicates([key])).select(*df.columns)


class _Exact:
    """Links by full sets: 100 * intersection >= threshold * union."""

    def __init__(self, sets: list[np.ndarray], threshold: int):
        self.size = np.array([len(s) for s in sets])
        self.threshold = threshold
        value, at = np.unique(np.concatenate(sets), return_inverse=True)
        member = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(at, kind="stable")
        self.member = member[order]
        self.start = np.searchsorted(at[order], np.arange(len(value) + 1))
        self.ends = np.concatenate([[0], np.cumsum(self.size)])
        self.at = at

    def __call__(self, x: int, rest: np.ndarray) -> np.ndarray:
        at = self.at[self.ends[x] : self.ends[x + 1]]
        first, count = self.start[at], self.start[at + 1] - self.start[at]
        places = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        shared = np.bincount(self.member[places], minlength=len(self.size))[rest]
        return (shared > 0) & (100 * shared >= self.threshold * (self.size[x] + self.size[rest] - shared))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents by three-word shingles at 0.85."""
    return near_duplicates(common.documents(spark, sf_dir), k=3, threshold=85)


#: The same rows by comparing all texts that share a shingle; for small tables.
SQL = """
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
shingle AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(node, component) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.component FROM reach r JOIN edge e ON e.a = r.node)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept FROM documents d LEFT JOIN size s ON s.doc_id = d.doc_id
JOIN (SELECT node, min(component) AS component_id FROM reach GROUP BY node) r ON r.node = d.doc_id"""
