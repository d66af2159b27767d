"""Ranked lexical search by WAND in each shard of documents.

A term's impact is what it adds to a document's score, in integers. A shard keeps, for every
term that some query asks for, the documents that hold it in order and the term's largest
impact, over the shard and over each block of documents. A query walks the shard with one
cursor a term: terms are ordered by the block of their next document, and the pivot is the first
at which the maxima so far exceed the least score of the query's full heap. Blocks before the
pivot's are skipped unread; in its block only documents whose terms' maxima exceed that bar
are scored. Shards' heaps are merged by Spark.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stillwave.llm import common

#: Digits, letters, and all signs beyond ASCII, as UTF-8.
TERM, BETWEEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+"), re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
#: Bytes of a text whose terms are listed at once; a longer one is cut between terms.
PIECE = 1 << 20
#: Documents and postings up to which a task's rows are one shard, and documents in a block.
SHARD, POSTINGS, BLOCK = 16_384, 4_000_000, 256
#: Terms of queries, on average, that are searched in one pass over the documents.
TERMS = 1 << 19
#: Parts in which the shards' heaps are merged before they meet.
MERGED = 32
TOP = 50
#: The scores' constants: weights are thousandths, saturation of 1000 tf against 20 m,
#: and m leans half towards a document's length.
UNIT, GAIN, SLOPE, LENGTH = 1000, 1_000_000_000, 20, 50


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, A-Z lowered, in lists of bounded length."""
    data, at = (text or "").encode().lower(), 0
    while at < len(data):
        end = BETWEEN.search(data, at + PIECE)
        stop = end.start() if end else len(data)
        yield TERM.findall(data, at, stop)
        at = stop


def weight(documents: int, holding: int) -> int:
    """Of a term that so many of the documents hold."""
    return floor(UNIT * log((2 * documents + 2) / (2 * holding + 1)))


def impact(w: int, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to the scores of documents that hold it."""
    return w * ((GAIN * tf) // (UNIT * tf + SLOPE * m))


def damping(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of documents with n terms each, where all have ``total``."""
    return 100 - LENGTH + (LENGTH * n * documents) // total


class Shard:
    """Postings of some documents, which are numbered in the order of their ids."""

    def __init__(self, docs: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, weights: np.ndarray):
        """``docs``, ``term``, ``tf``: the postings; ``m``: by document; ``weights``: by term."""
        order = np.lexsort((docs, term))
        self.docs, term = docs[order], term[order]
        self.impacts = impact(weights[term], tf[order], m[self.docs])
        self.size = len(m)
        known, starts = np.unique(term, return_index=True)
        stops = np.append(starts, len(term))[1:]
        self.ends = dict(zip(known.tolist(), zip(starts.tolist(), stops.tolist(), strict=True), strict=True))
        self.most = dict(zip(known.tolist(), np.maximum.reduceat(self.impacts, starts).tolist() if len(term) else [], strict=True))

    def best(self, query: list[int], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores of the k best above 0, ties to the smaller document, and the
        number of documents that were scored."""
        held = [t for t in query if self.most.get(t, 0) > 0]
        lists = [self.docs[slice(*self.ends[t])] for t in held]
        adds = [self.impacts[slice(*self.ends[t])] for t in held]
        most = np.array([self.most[t] for t in held], np.int64)
        at = [0] * len(held)
        top = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        bar, scored = 0, 0
        while True:
            # The block of each cursor's document; a list that is at its end stands beyond all.
            blocks = np.array([int(d[a]) // BLOCK if a < len(d) else self.size for d, a in zip(lists, at, strict=True)], np.int64)
            order = np.argsort(blocks, kind="stable")
            passing = np.flatnonzero(np.cumsum(most[order]) > bar)
            if not len(passing) or blocks[order[passing[0]]] >= self.size:
                return *top, scored
            block = int(blocks[order[passing[0]]])
            low, high = block * BLOCK, (block + 1) * BLOCK
            bound, score = np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
            parts = []
            for i in order[blocks[order] <= block].tolist():
                docs = lists[i]
                start, stop = (at[i] if blocks[i] == block else int(np.searchsorted(docs, low))), int(np.searchsorted(docs, high))
                at[i] = stop
                if start < stop:
                    here, add = docs[start:stop] - low, adds[i][start:stop]
                    bound[here] += add.max()
                    parts.append((here, add))
            alive = bound > bar
            if not alive.any():
                continue
            for here, add in parts:
                one = alive[here]
                score[here[one]] += add[one]
            scored += int(alive.sum())
            found = np.flatnonzero(score > bar)
            docs, scores = np.concatenate([top[0], found + low]), np.concatenate([top[1], score[found]])
            kept = np.lexsort((docs, -scores))[:k]
            top = docs[kept], scores[kept]
            if len(kept) == k:
                bar = int(top[1][-1])


def _items(items: DataFrame, text: str, id: str) -> DataFrame:
    """(``item``, ``item_id``, ``term``): each item's distinct terms; ``item`` numbers rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = TaskContext.get().partitionId() << 40
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                found = sorted({t for some in terms(value.as_py()) for t in some})
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array([key.as_py()] * len(found), batch.schema.types[0]), pa.array(found, pa.binary())], ["item", "item_id", "term"])
                item += 1

    kind = items.schema[id].dataType.simpleString()
    return items.select(items[id], items[text].cast("string")).mapInArrow(run, f"item long, item_id {kind}, term binary")


def _index(df: DataFrame, vocabulary: list[bytes], text: str, id: str) -> DataFrame:
    """(``uid``, ``id``, ``n``, ``terms``, ``tfs``): each row's number of terms, and which of the
    vocabulary it holds how often, as bytes of 32 bits."""
    numbers = df.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})
    kind = df.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbers.value.get
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            n, held, counts = [], [], []
            for value in batch.column(1):
                found, size = Counter(), 0
                for some in terms(value.as_py()):
                    size += len(some)
                    found.update(map(number, some))
                found.pop(None, None)
                n.append(size)
                held.append(np.fromiter(found.keys(), "<i4", len(found)).tobytes())
                counts.append(np.fromiter(found.values(), "<i4", len(found)).tobytes())
            columns = [pa.array(range(uid, uid + len(n)), pa.int64()), batch.column(0), pa.array(n, pa.int64()), pa.array(held, pa.binary()), pa.array(counts, pa.binary())]
            uid += len(n)
            yield pa.RecordBatch.from_arrays(columns, ["uid", "id", "n", "terms", "tfs"])

    return df.select(df[id], df[text].cast("string")).mapInArrow(run, f"uid long, id {kind}, n long, terms binary, tfs binary")


def _holding(index: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, np.int64)
        for batch in batches:
            found += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=size)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["term", "n"])

    out = np.zeros(size, np.int64)
    for r in index.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return out


def _heaps(index: DataFrame, queries: list[list[int]], weights: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """(``query``, ``uid``, ``id``, ``score``): each shard's best for each query. A task's rows are
    shards of bounded size, one after the other."""
    asked = index.sparkSession.sparkContext.broadcast((queries, weights))
    kind = index.schema["id"].dataType.simpleString()

    def search(part: pa.Table) -> Iterator[pa.RecordBatch]:
        queries, weights = asked.value
        part = part.sort_by([("id", "ascending"), ("uid", "ascending")])  # null ids come last
        held = [np.frombuffer(b, "<i4") for b in part.column("terms").to_pylist()]
        docs = np.repeat(np.arange(len(held)), [len(h) for h in held])
        tf = np.frombuffer(b"".join(part.column("tfs").to_pylist()), "<i4").astype(np.int64)
        m = damping(part.column("n").to_numpy(), documents, total)
        shard = Shard(docs, np.concatenate([*held, np.zeros(0, "<i4")]).astype(np.int64), tf, m, weights)
        for number, query in enumerate(queries):
            at, scores, _ = shard.best(query, k)
            if len(at):
                best = part.take(pa.array(at))
                yield from pa.table([pa.array(np.full(len(at), number)), best.column("uid"), best.column("id"), pa.array(scores)], ["query", "uid", "id", "score"]).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, postings = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, postings = rows + batch.num_rows, postings + batch.column("terms").nbytes // 4
            if rows >= SHARD or postings >= POSTINGS:
                yield from search(pa.Table.from_batches(held))
                held, rows, postings = [], 0, 0
        if held:
            yield from search(pa.Table.from_batches(held))

    return index.mapInArrow(run, f"query long, uid long, id {kind}, score long")


def search(df: DataFrame, items: DataFrame, k: int = TOP, text: str = "text", id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(``item_id``, ``rank``, ``id``, ``score``): the k documents of the highest scores above 0
    for each item, equal scores by ascending id (null ids last).

    A null or empty text has no terms: such a document counts nowhere and is never found, such
    an item finds nothing. Repeated rows are documents each, and items each, with ranks of their
    own. Terms that no document holds add nothing. Without documents or items the result is
    empty. Other columns are left out. Texts of any length are read whole.

    Documents are read once for each block of about TERMS of the items' terms, as the driver and
    each task hold one block's vocabulary: one read for any usual set of queries. What is
    kept of a document are its counts of these terms. The driver gets one number for each of
    them.
    """
    asked = common.written(_items(items, item_text, item_id))
    blocks = max(1, -(-asked.count() // TERMS))
    out = None
    for block in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        found = _searched(df, some.toArrow(), k, text, id)
        out = found if out is None else out.unionByName(found)
    kinds = (items.schema[item_id].dataType.simpleString(), df.schema[id].dataType.simpleString())
    return out.select(F.col("item_id").cast(kinds[0]), "rank", F.col("id").cast(kinds[1]).alias(id), "score")


def _searched(df: DataFrame, asked: pa.Table, k: int, text: str, id: str) -> DataFrame:
    spark = df.sparkSession
    vocabulary = sorted(set(asked.column("term").to_pylist()))
    number = {t: i for i, t in enumerate(vocabulary)}
    queries: dict[int, list[int]] = {}
    ids = {}
    for item, key, term in zip(*(asked.column(c).to_pylist() for c in ("item", "item_id", "term")), strict=True):
        queries.setdefault(item, []).append(number[term])
        ids[item] = key
    index = common.written(_index(df, vocabulary, text, id).filter("n > 0"))
    documents, total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.array([weight(documents, h) for h in _holding(index, len(vocabulary)).tolist()], np.int64)
    heaps = _heaps(index.filter("length(terms) > 0"), list(queries.values()), weights, documents, max(1, total), k)
    order = [F.desc("score"), F.asc_nulls_last("id"), "uid"]
    for parts in (["query", F.pmod(F.xxhash64("uid"), F.lit(MERGED))], ["query"]):
        heaps = heaps.withColumn("rank", F.row_number().over(Window.partitionBy(*parts).orderBy(*order))).filter(F.col("rank") <= k)
    kind = asked.schema.field("item_id").type
    names = spark.createDataFrame(pa.table([pa.array(range(len(ids)), pa.int64()), pa.array(ids.values(), kind)], ["query", "item_id"]))
    return heaps.join(F.broadcast(names), "query")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each item of the benchmark."""
    return search(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH words AS MATERIALIZED (SELECT doc_id, unnest({_TERMS}) AS term FROM documents WHERE text IS NOT NULL),
     lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
     corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
     asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
     held AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
     weights AS (SELECT term, CAST(floor({UNIT} * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, corpus GROUP BY term),
     damped AS (SELECT doc_id, {100 - LENGTH} + (({LENGTH} * n * docs) // total) AS m FROM lengths, corpus),
     scored AS (SELECT item_id, doc_id, CAST(sum(w * (({GAIN} * tf) // ({UNIT} * tf + {SLOPE} * m))) AS BIGINT) AS score
                FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN damped USING (doc_id) GROUP BY item_id, doc_id HAVING score > 0),
     ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}"""
