"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, for every language at once, which n-grams of letters it
has: a slot is a bitmask with one bit for each language, and the AND of an n-gram's slots is
the mask of all languages that contain it. A text's n-grams are looked up together; the
masks are counted by language, the counts are corrected for the filter's false positives,
and the largest decides.

The filter is fitted on a bounded, documented sample of labelled texts; every text is then
scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwave.llm import common

#: Texts that are learned from for a language (on average), each whole.
TEXTS = 400
#: Signs in an n-gram; words are padded with a blank on either side.
N = (3, 4)
#: Slots of the filter and hash functions.
SLOTS, HASHES = 1 << 18, 3
#: An n-gram goes in for a language if it makes up at least so much of the language's
#: n-grams (so no more than one over this go in), and at least this part of what it makes up
#: in the language that has it most.
LEAST_RATE, LEAST_PART = 4e-5, 0.3
#: Characters that are looked up at once.
BLOCK = 1 << 17

_LETTER = re.compile(r"[^\W\d_]")
_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Blocks of about BLOCK characters: whole texts, and long ones cut at blanks, each
    with its place in the list."""
    at, block, size = [], [], 0
    for i, text in enumerate(texts):
        start = 0
        while text and start < len(text):
            end = len(text)
            if end - start > BLOCK:
                end = text.rfind(" ", start + BLOCK // 2, start + BLOCK) + 1 or start + BLOCK
            at.append(i)
            block.append(text[start:end].lower())
            size += end - start
            start = end
            if size >= BLOCK:
                yield at, block
                at, block, size = [], [], 0
    if block:
        yield at, block


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n, the 64-bit hashes of the lowered texts' n-grams of letters, none across
    words, and the text that each is from. Words are padded with a blank on either side."""
    c = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    letter = (c >= 97) & (c <= 122)
    high = np.flatnonzero(c >= 128)
    if len(high):
        kinds, back = np.unique(c[high], return_inverse=True)
        letter[high] = np.array([chr(k).isalpha() if not 0xD800 <= k < 0xE000 else False for k in kinds])[back]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    kept = np.flatnonzero(keep)
    text_of = np.searchsorted(ends, kept, side="right").astype(np.int64)
    letter = letter[kept]
    c = np.where(letter, c[kept], np.uint32(32)).astype(np.uint64)
    for n in N:
        m = len(c) - n + 1
        if m < 1:
            continue
        h = np.full(m, n, np.uint64)
        inside = np.ones(m, bool)
        for k in range(n):
            h ^= c[k : k + m]
            h *= _MULTIPLY[0]
            if 0 < k < n - 1:
                inside &= letter[k : k + m]
        h ^= h >> np.uint64(29)
        # A letter in the middle shows whose n-gram it is; the blank before may be another's.
        yield h[inside], text_of[1 : 1 + m][inside]


@dataclass
class Filter:
    """Languages by bit, the slots' masks, and each language's rate of false positives."""

    languages: list[str]
    slots: np.ndarray
    false: np.ndarray

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        mask = None
        for k in range(HASHES):
            at = (hashes * _MULTIPLY[k + 1]) >> np.uint64(64 - SLOTS.bit_length() + 1)
            found = self.slots[at.astype(np.int64)]
            mask = found if mask is None else mask & found
        return mask

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """By text and language, the n-grams that it contains; by text, all n-grams."""
        found, total = np.zeros((len(texts), len(self.languages)), np.int64), np.zeros(len(texts), np.int64)
        bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
        for at, block in pieces(texts):
            for h, text_of in grams(block):
                np.add.at(total, at, np.bincount(text_of, minlength=len(block)))
                mask = self.masks(h)
                for first in range(0, len(self.languages), 8):
                    eight = (mask[:, first // 64] >> np.uint64(first % 64)) & np.uint64(255)
                    by_mask = np.bincount(text_of * 256 + eight.astype(np.int64), minlength=256 * len(block))
                    by_bit = by_mask.reshape(-1, 256) @ bits
                    width = min(8, len(self.languages) - first)
                    np.add.at(found[:, first : first + width], at, by_bit[:, :width])
        return found, total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The languages and their corrected shares of the n-grams, 0 to 1."""
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        found, total = self.counts(texts)
        share = (found / np.maximum(1, total)[:, None] - self.false) / np.maximum(1e-9, 1 - self.false)
        best = np.argmax(share, axis=1)
        score = np.clip(share[np.arange(len(texts)), best], 0.0, 1.0)
        und = [not n or not t or not _LETTER.search(t) for n, t in zip(total.tolist(), texts, strict=True)]
        names = ["und" if u else self.languages[b] for u, b in zip(und, best.tolist(), strict=True)]
        return names, [0.0 if u else x for u, x in zip(und, score.tolist(), strict=True)]


def build(counted: dict[str, dict[int, int]], totals: dict[str, int] | None = None) -> Filter:
    """A filter from each language's counts by n-gram hash; ``totals`` are the counts of all its
    n-grams, if these are but some."""
    languages = sorted(counted)
    totals = totals or {name: max(1, sum(c.values())) for name, c in counted.items()}
    most: dict[int, float] = {}
    for name, c in counted.items():
        for g, k in c.items():
            most[g] = max(most.get(g, 0.0), k / totals[name])
    slots = np.zeros((SLOTS, max(1, -(-len(languages) // 64))), np.uint64)
    for bit, name in enumerate(languages):
        rates = ((k / totals[name], g) for g, k in counted[name].items())
        kept = sorted((r, g) for r, g in rates if r >= LEAST_RATE and r >= LEAST_PART * most[g])
        h = np.array([g for _, g in kept], np.uint64)
        for k in range(HASHES):
            at = ((h * _MULTIPLY[k + 1]) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
            slots[at, bit // 64] |= np.uint64(1) << np.uint64(bit % 64)
    fill = np.array([((slots[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)).mean() for b in range(len(languages))])
    return Filter(languages, slots, fill**HASHES)


def fit(df: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id") -> Filter:
    """A filter from labelled rows: for each language about TEXTS rows, those of the
    smallest hashes of their id, each whole. Rows without text or label teach nothing. The
    languages are the labels of those rows.

    How many rows a language has decides below which hash its rows are taken. Tasks count the
    n-grams of their rows, Spark adds the counts up, and what reaches the driver are the
    n-grams that make up at least LEAST_RATE of a language, at most one over it.
    """
    rows = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    known = rows.groupBy(F.col(lang).cast("string").alias("l")).count().collect()
    if not known:
        return build({}, {})
    chance = F.create_map(*[F.lit(x) for r in known for x in (r.l, min(1.0, TEXTS / r["count"]))])
    rows = rows.select(F.col(lang).cast("string").alias("_l"), F.col(text).cast("string").alias("_t"), F.xxhash64(id).alias("_o"))
    rows = rows.filter(F.pmod("_o", F.lit(1 << 40)) < F.lit(float(1 << 40)) * F.element_at(chance, F.col("_l"))).select("_l", "_t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(name, []).append(value)
            for name, some in texts.items():
                for _, block in pieces(some):
                    for h, _ in grams(block):
                        counted[name] = _added(*counted.get(name, (h[:0], np.empty(0, np.int64))), *np.unique(h, return_counts=True))
        for name, (h, n) in counted.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["l", "h", "n"])

    counted = common.cut(rows.mapInArrow(count, "l string, h long, n long").groupBy("l", "h").agg(F.sum("n").alias("n")))
    totals = {r.l: r.n for r in counted.groupBy("l").agg(F.sum("n").alias("n")).collect()}
    least = F.create_map(*[F.lit(x) for name, n in totals.items() for x in (name, max(2.0, LEAST_RATE * n))]) if totals else F.lit(None)
    found: dict[str, dict[int, int]] = {r.l: {} for r in known}
    for r in counted.filter(F.col("n") >= F.element_at(least, F.col("l"))).collect() if totals else []:
        found[r.l][r.h & (2**64 - 1)] = r.n
    return build(found, {name: max(1, totals.get(name, 0)) for name in found})


def _added(h: np.ndarray, n: np.ndarray, more: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of two sets of hashes together."""
    found, at = np.unique(np.concatenate([h, more]), return_inverse=True)
    return found, np.bincount(at, np.concatenate([n, times]), len(found)).astype(np.int64)


def predict(df: DataFrame, filter: Filter, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row for each row of ``df``: ``id``, ``lang_pred`` and ``score`` (the corrected
    share of the text's n-grams that the language contains, 0 to 1).

    A text that is null or has no letter, or any text if nothing was learned, is ``und``
    with score 0. Equal shares go to the language whose name sorts first. Repeated rows are
    predicted each by itself, an empty table gives an empty result, and no other column
    is read. A text of any length is scored whole, in blocks.
    """
    shared = df.sparkSession.sparkContext.broadcast(filter)  # SLOTS masks at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, scores = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["id", "lang_pred", "score"],
            )

    kind = df.schema[id].dataType.simpleString()
    return df.select(df[id], df[text].cast("string")).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id)


def keep(df: DataFrame, filter: Filter, least: float, text: str = "text") -> DataFrame:
    """The rows of ``df`` in a language, with a share of at least ``least`` of their
    n-grams, and with all their columns."""
    shared = df.sparkSession.sparkContext.broadcast(filter)

    @F.pandas_udf("boolean")
    def in_language(texts: pd.Series) -> pd.Series:
        names, scores = shared.value.predict(list(texts))
        return pd.Series([n != "und" and s >= least for n, s in zip(names, scores, strict=True)], dtype="bool")

    return df.filter(in_language(F.col(text).cast("string")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those outside the held-out third."""
    docs = common.documents(spark, sf_dir)
    fold = common.crc32_of(F.col("doc_id")) % 3 == 1
    model = fit(docs.filter(~fold))
    return predict(docs, model).select("doc_id", fold.alias("held_out"), "lang_pred", "score")
