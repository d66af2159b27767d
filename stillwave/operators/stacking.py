"""Stacks, histograms and significant peaks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Samples of sums that a task holds before it passes them on.
HELD = 8_000_000


def linear_stack(df: DataFrame, keys: list[str], array: str, least: int = 1) -> DataFrame:
    """``stack``, the elementwise mean of a group's arrays, and ``no_ccfs``, of groups of at
    least so many. A place that only some arrays have is their mean; null arrays don't count.

    Tasks add up the arrays of each key before anything is shuffled, so what meets for a key
    is one array of sums from each task, however many rows the key has.
    """
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, "sums", "counts", "n"]

    def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if len(a) < len(b):
            a, b = b, a
        out = a.copy()
        out[: len(b)] += b
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray, int]] = {}
        schema, size = None, 0

        def out() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], t) for i, t in enumerate(schema)]
            sums, counts, n = zip(*held.values(), strict=True)
            columns += [pa.array(sums, pa.list_(pa.float64())), pa.array(counts, pa.list_(pa.int64())), pa.array(n, pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            schema = [batch.schema.field(i).type for i in range(len(keys))]
            for *key, v in zip(*(c.to_pylist() for c in batch.columns[: len(keys)]), batch.column(len(keys)), strict=True):
                if not v.is_valid:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(float)
                s, c, n = held.get(tuple(key), (x[:0], np.empty(0, np.int64), 0))
                held[tuple(key)] = (added(s, x), added(c, np.ones(len(x), np.int64)), n + 1)
                size += max(0, len(x) - len(s)) + (n == 0)
                if size >= HELD:
                    yield out()
                    size = 0
        if held:
            yield out()

    def together(group: pa.Table) -> pa.Table:
        sums, counts = np.empty(0), np.empty(0, np.int64)
        for s, c in zip(group["sums"], group["counts"], strict=True):
            sums, counts = added(sums, s.values.to_numpy(zero_copy_only=False)), added(counts, c.values.to_numpy(zero_copy_only=False))
        return pa.table([*(group[k].slice(0, 1) for k in keys), pa.array([sums / np.maximum(counts, 1)], pa.list_(pa.float64())), pa.array([sum(group["n"].to_pylist())], pa.int64())], names=[*keys, "stack", "no_ccfs"])

    parts = df.select(*keys, F.col(array).cast("array<double>")).mapInArrow(run, f"{kinds}, sums array<double>, counts array<long>, n long")
    return parts.groupBy(*keys).applyInArrow(together, f"{kinds}, stack array<double>, no_ccfs long").filter(F.col("no_ccfs") >= least)


def histogram(df: DataFrame, keys: list[str], value: str, low: float, step: float, bins: int) -> DataFrame:
    """Counts by bin; the last one is closed on the right, what lies outside is left out."""
    v, high = F.col(value), low + step * bins
    bin_ = F.when(v == high, F.lit(bins - 1)).otherwise(F.floor((v - low) / step)).cast("int")
    return df.filter((v >= low) & (v <= high)).groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"))


def significant_peaks(df: DataFrame, time: str, place: list[str], amplitude: str, threshold: float) -> DataFrame:
    """Peaks by place: mean amplitude, occurrences, and the sum of their shares of each
    time's amplitudes. The threshold is halved as often as it takes for something to exceed
    it, which has a closed form in the largest share."""
    share = F.col(amplitude) / F.sum(amplitude).over(Window.partitionBy(time))
    found = df.withColumn("_share", share).groupBy(*place).agg(F.avg(amplitude).alias(amplitude), F.count("*").alias("occurrences"), F.sum("_share").alias("share"))
    halvings = F.greatest(F.lit(0.0), F.floor(F.log2(F.lit(threshold) / F.max("share"))) + 1)
    limit = found.agg((F.lit(threshold) / F.pow(F.lit(2.0), halvings)).alias("_t"))
    return found.crossJoin(F.broadcast(limit)).filter(F.col("share") > F.col("_t")).drop("_t")  # one row
