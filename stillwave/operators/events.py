"""Detection of transient events and their confirmation by votes of stations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sta_lta(df: DataFrame, by: list[str], order: list[str], value: str, short: int, long: int) -> DataFrame:
    """``ratio`` of the mean squares of the last ``short`` and ``long`` samples; 0 until a
    long window is full."""
    w = Window.partitionBy(*by).orderBy(*order)
    square = F.col(value) * F.col(value)
    mean = lambda n: F.avg(square).over(w.rowsBetween(-(n - 1), 0))
    return df.withColumn("ratio", F.when(F.row_number().over(w) >= long, mean(short) / mean(long)).otherwise(F.lit(0.0)))


def hysteresis(df: DataFrame, by: list[str], order: list[str], ratio: str, on: float, off: float) -> DataFrame:
    """``active``: from a sample above ``on`` until one at or below ``off``. The last sample
    that decided either way decides."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    decided = F.when(F.col(ratio) > on, True).when(F.col(ratio) <= off, False)
    return df.withColumn("active", F.coalesce(F.last(decided, ignorenulls=True).over(w), F.lit(False)))


def islands(df: DataFrame, by: list[str], order: list[str], flag: str, *aggregates: Column) -> DataFrame:
    """One row for each run of true flags, with the given aggregates; runs that are open at
    the end count."""
    w = Window.partitionBy(*by).orderBy(*order)
    numbered = df.withColumn("_run", F.row_number().over(w) - F.sum(F.col(flag).cast("int")).over(w)).filter(F.col(flag))
    return numbered.groupBy(*by, "_run").agg(*aggregates).drop("_run")


def spikes(df: DataFrame, by: list[str], order: list[str], value: str, threshold: float, tolerance: int) -> DataFrame:
    """``active``: whether a sample of at least the threshold is within so many samples."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-tolerance, tolerance)
    return df.withColumn("active", F.max((F.abs(F.col(value)) >= threshold).cast("int")).over(w) == 1)


def slots(df: DataFrame, start: str, stop: str, base: str, slot_s: int, lag_s: int, count: int) -> DataFrame:
    """Detections once for each ``slot`` with slot end >= start - lag and slot start < stop
    + lag; a detection names its own slots, so there is no range join."""
    micros = lambda c: F.unix_micros(c.cast("timestamp_ltz"))
    since = lambda c, lag: micros(F.col(c)) - micros(F.lit(base).cast("timestamp_ntz")) + lag * 1_000_000
    length = slot_s * 1_000_000
    first = F.greatest(F.ceil(since(start, -lag_s) / length) - 1, F.lit(0)).cast("long")
    last = F.least(F.ceil(since(stop, lag_s) / length) - 1, F.lit(count - 1)).cast("long")
    return df.withColumn("_first", first).withColumn("_last", last).filter("_first <= _last").withColumn("slot", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")


def confirmations(voted: DataFrame, by: list[str], weight: str, detection: str, least: float) -> DataFrame:
    """Runs of slots whose votes reach the threshold: ``first_slot``, ``last_slot``, the most
    ``votes`` and the ``detections`` that took part, sorted."""
    counted = voted.groupBy(*by, "slot").agg(F.sum(weight).alias("votes"))
    w = Window.partitionBy(*by).orderBy("slot")
    runs = counted.filter(F.col("votes") >= least).withColumn("run", F.col("slot") - F.row_number().over(w))
    events = runs.groupBy(*by, "run").agg(F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.max("votes").alias("votes"))
    members = voted.join(runs.select(*by, "slot", "run"), [*by, "slot"]).groupBy(*by, "run").agg(F.array_sort(F.collect_set(detection)).alias("detections"))
    return events.join(members, [*by, "run"]).drop("run")


def nearest_detection(df: DataFrame, by: list[str], distance: Column, id: str) -> DataFrame:
    """One detection for each event and station: the nearest, ties to the smaller id."""
    w = Window.partitionBy(*by).orderBy(distance, id)
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
