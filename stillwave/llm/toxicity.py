"""Toxicity by cumulative-link ordinal regression over sparse text features.

A document's severity has ordered grades, which are the distinct values of its label in
rising order (the given tables have two, 0 and 1; any number works). One weight vector is shared by all thresholds: P(grade > k) = logistic(w x - t_k) with rising
t_k, and the expected severity is the sum of these probabilities. Features are the presence
of words that tell the grades apart.

The regression is fitted on a bounded, documented sample of labelled documents; every text
is then scored whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwave.llm import common

#: Labelled documents that are learned from (on average), each whole.
LABELLED = 5_000
#: A word that becomes a feature is in at least so many labelled documents.
LEAST_DOCUMENTS = 3
#: Its evidence (log-likelihood ratio of its counts) is at least this and twice the log of the
#: number of words tested, a bar that about one of them passes by chance.
EVIDENCE = -4.0
#: Documents of at least this expected severity, in grades, are rejected.
REJECT = 0.3

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    """The distinct runs of letters in a text, lowered."""
    return set(_WORD.findall(text.lower())) if text else set()


@dataclass
class Ordinal:
    """Weights by word, and the rising thresholds."""

    weights: dict[str, float]
    thresholds: np.ndarray

    def __post_init__(self):
        self.known = frozenset(self.weights)

    def severity(self, text: str | None) -> float:
        # Summed in the order of the words, so that equal texts have equal scores.
        x = sum(self.weights[w] for w in sorted(self.known & words(text)))
        return float((1 / (1 + np.exp(np.clip(self.thresholds - x, -50, 50)))).sum())


@dataclass
class Bags:
    """Documents as sets of words: the words in order, and which document has which."""

    words: list[str]
    rows: np.ndarray
    places: np.ndarray
    size: int

    @staticmethod
    def of(lists: pa.ListArray | pa.ChunkedArray) -> Bags:
        """From lists of distinct words, which are held once, however many documents they are in."""
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        coded = lists.flatten().dictionary_encode()
        found = coded.dictionary.to_pylist()
        order = sorted(range(len(found)), key=found.__getitem__)
        rank = np.empty(len(found), np.int64)
        rank[order] = np.arange(len(found))
        rows = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        return Bags([found[k] for k in order], rows, rank[coded.indices.to_numpy(zero_copy_only=False)] if len(found) else rows, len(lists))

    def distinct(self, grade: np.ndarray) -> tuple[Bags, np.ndarray]:
        """One of equal documents of a grade, in an order that doesn't depend on the rows'."""
        order = np.lexsort((self.places, self.rows))
        rows, places = self.rows[order], self.places[order]
        ends = np.searchsorted(rows, np.arange(self.size + 1))
        first = {(int(grade[k]), places[s:e].astype(">u4").tobytes()): k for k, (s, e) in enumerate(zip(ends, ends[1:], strict=False))}
        kept = [first[key] for key in sorted(first)]
        parts = [places[ends[k] : ends[k + 1]] for k in kept]
        rows = np.repeat(np.arange(len(kept)), [len(p) for p in parts])
        return Bags(self.words, rows, np.concatenate(parts) if parts else places[:0], len(kept)), grade[kept]

    def select(self, toxic: np.ndarray) -> list[int]:
        """Places of the words with enough evidence for or against, each by itself, strongest
        first."""
        m, n1 = len(self.words), int(toxic.sum())
        n0 = self.size - n1
        c1 = np.bincount(self.places, toxic[self.rows].astype(float), m)
        c0 = np.bincount(self.places, minlength=m) - c1
        share = (c0 + c1) / max(1, self.size)
        score = np.zeros(m)
        for c, n, even in ((c1, n1, share), (c0, n0, share), (n1 - c1, n1, 1 - share), (n0 - c0, n0, 1 - share)):
            with np.errstate(divide="ignore", invalid="ignore"):
                score += np.where(c > 0, 2 * c * np.log(c / (n * even)), 0.0)
        tested = np.flatnonzero(c0 + c1 >= LEAST_DOCUMENTS)
        least = EVIDENCE + 2 * math.log(max(1, len(tested)))
        tested = tested[score[tested] >= least]
        return tested[np.lexsort((tested, -score[tested]))].tolist()

    def presence(self, chosen: list[int]) -> Presence:
        """Which documents have which of the words at these places."""
        column = np.full(len(self.words), -1, np.int64)
        column[chosen] = np.arange(len(chosen))
        held = column[self.places] if len(self.words) else self.places
        return Presence(self.rows[held >= 0], held[held >= 0], (self.size, len(chosen)))


def _bags(documents: list[set[str]]) -> Bags:
    return Bags.of(pa.array([sorted(d) for d in documents], pa.list_(pa.string())))


def select(documents: list[set[str]], toxic: np.ndarray) -> list[str]:
    """The words with enough evidence for or against, strongest first."""
    bags = _bags(documents)
    return [bags.words[k] for k in bags.select(toxic)]


class Presence:
    """A matrix of zeros and of ones at (``rows``, ``columns``), for products with vectors."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, shape: tuple[int, int]):
        self.rows, self.columns, self.shape = rows, columns, shape

    @property
    def T(self) -> Presence:
        return Presence(self.columns, self.rows, self.shape[::-1])

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, v[self.columns], self.shape[0])


def presence(documents: list[set[str]], names: list[str]) -> Presence:
    """Which documents have which of the words."""
    bags = _bags(documents)
    at = {w: k for k, w in enumerate(bags.words)}
    found = bags.presence([at[w] for w in names if w in at])
    columns = np.array([k for k, w in enumerate(names) if w in at], np.int64)
    return Presence(found.rows, columns[found.columns] if len(columns) else found.columns, (len(documents), len(names)))


def regress(x: np.ndarray | Presence, grade: np.ndarray, grades: int, steps: int = 600, rate: float = 0.05, penalty: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the largest penalised likelihood, by Adam on all rows.

    P(grade = k) = s(t_k - wx) - s(t_(k-1) - wx); the thresholds are the first one and
    positive steps, so they rise.
    """
    n, m = x.shape
    w, first, gaps = np.zeros(m), np.array([float(np.log((grade == 0).sum() + 1) - np.log((grade > 0).sum() + 1))]), np.zeros(grades - 2)
    theta = np.concatenate([w, first, gaps])
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    logistic = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
    rows = np.arange(n)
    for step in range(1, steps + 1):
        w, width = theta[:m], np.exp(theta[m + 1 :])
        cut = np.concatenate([[-40.0], theta[m] + np.concatenate([[0.0], np.cumsum(width)]), [40.0]])
        z = x @ w
        up, low = logistic(cut[grade + 1] - z), logistic(cut[grade] - z)
        up = np.where(grade == grades - 1, 1.0, up)
        low = np.where(grade == 0, 0.0, low)
        p = np.maximum(up - low, 1e-9)
        d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
        by_cut = np.zeros((n, grades - 1))
        inner = grade < grades - 1
        by_cut[rows[inner], grade[inner]] += d_up[inner]
        inner = grade > 0
        by_cut[rows[inner], grade[inner] - 1] -= d_low[inner]
        g_cut = by_cut.sum(0)
        gradient = np.concatenate([x.T @ -(d_up - d_low) - penalty * w, [g_cut.sum()], g_cut[::-1].cumsum()[::-1][1:] * width - 0.1 * theta[m + 1 :]]) / max(1, n)
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        theta = theta + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    width = np.exp(theta[m + 1 :])
    return theta[:m], theta[m] + np.concatenate([[0.0], np.cumsum(width)])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id") -> Ordinal:
    """A model from labelled documents: of the ids with a label about LABELLED, those of the
    smallest hashes, and all distinct words of their texts. With fewer than two distinct
    grades, everything has severity 0.

    Of several labels of one id the highest grade counts, and of several rows of one id the
    text of the smallest hash, so ids that repeat neither weigh more nor swell the sample.
    """
    chosen = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    chosen = chosen.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_grade"))
    share = min(1.0, LABELLED / max(1, chosen.count()))
    chosen = chosen.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) < share * (1 << 40))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(words(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["grade", "words"])

    # The labels are about LABELLED rows of 16 bytes, so they are sent to every task.
    rows = docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_text")).join(F.broadcast(chosen), "_id")
    rows = rows.groupBy("_id", "_grade").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    rows = rows.select("_grade", "_text").mapInArrow(features, "grade int, words array<string>").toArrow()
    values, grade = np.unique(rows["grade"].to_numpy(), return_inverse=True)
    if len(values) < 2:
        return Ordinal({}, np.array([50.0]))
    # Copies would count as evidence again and again, so one of equal documents stays.
    bags, grade = Bags.of(rows["words"]).distinct(grade)
    chosen = bags.select((grade > 0).astype(np.int64))
    w, thresholds = regress(bags.presence(chosen), grade, len(values))
    return Ordinal(dict(zip([bags.words[k] for k in chosen], w.tolist(), strict=True)), thresholds)


def score(df: DataFrame, model: Ordinal, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row for each row of ``df``: ``id``, ``severity`` (expected grade, from 0) and
    ``rejected`` (severity of at least REJECT).

    A null or empty text is scored as one without any feature. Repeated rows are scored
    each by itself, an empty table gives an empty result, and other columns are left out.
    A text of any length is scored whole.
    """
    return df.select(F.col(id), _severity(model)(F.col(text).cast("string")).alias("severity")).withColumn("rejected", F.col("severity") >= REJECT)


def keep(df: DataFrame, model: Ordinal, text: str = "text") -> DataFrame:
    """The rows of ``df`` that aren't rejected, with all their columns."""
    return df.filter(_severity(model)(F.col(text).cast("string")) < REJECT)


def _severity(model: Ordinal):
    @F.pandas_udf("double")
    def severity(texts: pd.Series) -> pd.Series:
        return pd.Series([model.severity(t) for t in texts], dtype="float64")

    return severity


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected severity of all documents."""
    docs = common.documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
