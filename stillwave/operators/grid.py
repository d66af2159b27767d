"""The shared grid of analysis windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stillwave.functions import columns as C


def window_step(length_s: float, step_s: float | None = None, overlap_s: float | None = None) -> float:
    """The step of a grid, from exactly one of step and overlap."""
    if (step_s is None) == (overlap_s is None):
        raise ValueError("give either a step or an overlap")
    step = step_s if step_s is not None else length_s - overlap_s
    if step <= 0:
        raise ValueError("the overlap must be shorter than the window")
    return step


def timespans(spark: SparkSession, start: str, end: str, length_s: float, overlap_s: float = 0.0, across_midnight: bool = False) -> DataFrame:
    """Windows ``starttime``, ``midtime``, ``endtime`` from the midnight before ``start`` to
    the one before ``end``, without those that cross midnight unless asked for."""
    step = window_step(length_s, overlap_s=overlap_s)
    micros = lambda s: f"make_dt_interval(0, 0, 0, {s:.6f})"
    grid = spark.sql(
        f"""SELECT explode(sequence(CAST(date_trunc('DAY', TIMESTAMP_NTZ'{start}') AS TIMESTAMP_NTZ),
                                    CAST(date_trunc('DAY', TIMESTAMP_NTZ'{end}') AS TIMESTAMP_NTZ) - interval 1 microsecond,
                                    {micros(step)})) AS starttime"""
    )
    grid = grid.select(
        "starttime",
        (F.col("starttime") + F.expr(micros(length_s / 2))).alias("midtime"),
        (F.col("starttime") + F.expr(micros(length_s))).alias("endtime"),
    )
    return grid if across_midnight else grid.filter(C.same_day(F.col("starttime"), F.col("endtime")))


def between(spans: DataFrame, start: Column, end: Column) -> DataFrame:
    """Windows that lie fully between two times."""
    return spans.filter((F.col("starttime") >= start) & (F.col("endtime") <= end))


def of_day(spans: DataFrame, year: int, doy: int) -> DataFrame:
    """Windows whose middle is on a day of a year."""
    return spans.filter((F.year("midtime") == year) & (F.dayofyear("midtime") == doy))


def choose(
    spans: DataFrame,
    start: Column | None = None,
    end: Column | None = None,
    accepted: list[int] | None = None,
    rejected: list[int] | None = None,
    weekdays: list[int] | None = None,
    hours: list[int] | None = None,
    id: str = "timespan_id",
) -> DataFrame:
    """Windows by start (both bounds are of the start time), id, ISO weekday and hour of
    the middle; what isn't given isn't asked."""
    tests = [
        None if start is None else F.col("starttime") >= start,
        None if end is None else F.col("starttime") <= end,
        None if accepted is None else F.col(id).isin(accepted),
        None if rejected is None else ~F.col(id).isin(rejected),
        None if weekdays is None else (F.weekday("midtime") + 1).isin(weekdays),
        None if hours is None else F.hour("midtime").isin(hours),
    ]
    for test in tests:
        if test is not None:
            spans = spans.filter(test)
    return spans


def bucketed_range_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, bucket_s: int, closed: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Points joined with the windows that hold them, [start, end) or, if ``closed``,
    [start, end].

    A window is listed under every bucket of time that it touches and a point under its own,
    so the join is an equi-join on the bucket and any further keys, of which each pair meets
    once; a plain range condition would compare all with all.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp_ltz")) / (bucket_s * 1_000_000)).cast("long")
    listed = spans.withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    held = (F.col(at) >= F.col(start)) & ((F.col(at) <= F.col(end)) if closed else (F.col(at) < F.col(end)))
    return points.withColumn("_bucket", bucket(at)).join(listed, ["_bucket", *keys]).filter(held).drop("_bucket")


def bucketed_containment_join(inner: DataFrame, outer: DataFrame, inner_start: str, inner_end: str, outer_start: str, outer_end: str, bucket_s: int) -> DataFrame:
    """Windows joined with the larger ones that contain them: the inner start decides the
    bucket, the outer window is listed under all of its own."""
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp_ltz")) / (bucket_s * 1_000_000)).cast("long")
    listed = outer.withColumn("_bucket", F.explode(F.sequence(bucket(outer_start), bucket(outer_end))))
    inside = (F.col(outer_start) <= F.col(inner_start)) & (F.col(inner_end) <= F.col(outer_end))
    return inner.withColumn("_bucket", bucket(inner_start)).join(listed, "_bucket").filter(inside).drop("_bucket")


def overlapping_pairs(df: DataFrame, keys: list[str], start: str, end: str, bucket_s: int) -> DataFrame:
    """Pairs of rows of equal keys whose periods overlap, ends included: the keys, and all other
    columns with ``a`` and ``b`` added to their names. Each row meets itself too.

    A period is listed under the buckets of time that it touches, and two meet in the first one
    that both touch, so rows far apart are never compared. Null keys and times match nothing.
    """
    number = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp_ltz")) / (bucket_s * 1_000_000)).cast("long")
    rest = [c for c in df.columns if c not in keys]
    listed = df.withColumn("_first", number(start)).withColumn("_bucket", F.explode(F.sequence("_first", number(end))))
    a, b = (listed.select(*keys, "_bucket", F.col("_first").alias(f"_first{k}"), *(F.col(c).alias(f"{c}{k}") for c in rest)) for k in "ab")
    met = a.join(b, [*keys, "_bucket"]).filter(F.col("_bucket") == F.greatest("_firsta", "_firstb"))
    return met.filter(C.overlaps(*(F.col(f"{c}{k}") for k in "ab" for c in (start, end)))).drop("_bucket", "_firsta", "_firstb")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, right_time: str, name: str = "found", tolerance_s: float | None = None, bucket_s: int = 3600, carried: int = 1024) -> DataFrame:
    """``left`` with ``name``, a struct of ``right``'s columns: its last row of equal keys at or before
    ``time``, if that is within the tolerance (inclusive), else null.

    Of right rows of one key and time the one of the largest columns counts. Left rows with a
    null key or time find nothing, right rows with one are left out. Repeated left rows stay.

    Both sides are dealt to buckets of time, and within one the last row so far is found by a
    window. What comes before a bucket is one row: the last one of the buckets before,
    found among the buckets' last rows, ``carried`` buckets at a time, so no window sees
    more of a key than that, and a key with most of the rows is as many tasks as buckets.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp_ltz"))
    names = [f"_k{i}" for i in range(len(keys))]
    own = lambda: [F.col(c).alias(n) for c, n in zip(keys, names, strict=True)]
    whole = lambda t: reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, t]])
    bucket = F.floor(F.col("_t") / F.lit(bucket_s * 1_000_000)).alias("_b")
    top = F.floor(F.col("_b") / F.lit(carried)).alias("_s")
    rows = right.filter(whole(right_time)).select(*own(), micros(right_time).alias("_t"), F.struct(*right.columns).alias("_r")).select("*", bucket)
    asked = left.filter(whole(time)).select(*own(), micros(time).alias("_t"), F.struct(*left.columns).alias("_l")).select("*", bucket)

    # The last row of each bucket, and of each run of buckets; both without the rows themselves.
    ends = rows.groupBy(*names, "_b").agg(F.max(F.struct("_t", "_r")).alias("_end")).select("*", top)
    wanted = asked.select(*names, "_b").distinct().select("*", top)
    runs = ends.groupBy(*names, "_s").agg(F.max("_end").alias("_end"))
    before = lambda order, *by: F.last("_end", ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    nothing = F.lit(None).cast(ends.schema["_end"].dataType)
    every = runs.withColumn("_end", F.col("_end")).unionByName(wanted.select(*names, "_s").distinct().withColumn("_end", nothing))
    every = every.groupBy(*names, "_s").agg(F.max("_end").alias("_end")).withColumn("_earlier", before("_s", *names)).select(*names, "_s", "_earlier")
    marks = ends.unionByName(wanted.withColumn("_end", nothing)).groupBy(*names, "_b", "_s").agg(F.max("_end").alias("_end"), F.max(F.col("_end").isNull()).alias("_asked"))
    carry = marks.withColumn("_within", before("_b", *names, "_s")).filter("_asked").join(every, [*names, "_s"])
    carry = carry.select(*names, "_b", F.coalesce("_within", "_earlier").alias("_c")).filter("_c is not null")

    no_l, no_r = F.lit(None).cast(asked.schema["_l"].dataType).alias("_l"), F.lit(None).cast(rows.schema["_r"].dataType).alias("_r")
    parts = [
        carry.select(*names, "_b", F.lit(0).alias("_kind"), F.col("_c._t").alias("_t"), F.col("_c._r").alias("_r"), no_l),
        rows.select(*names, "_b", F.lit(1).alias("_kind"), "_t", "_r", no_l),
        asked.select(*names, "_b", F.lit(2).alias("_kind"), "_t", no_r, "_l"),
    ]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    last = F.last(F.when(F.col("_kind") < 2, F.struct("_t", "_r")), ignorenulls=True).over(Window.partitionBy(*names, "_b").orderBy("_t", "_kind", "_r").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn("_last", last).filter("_kind = 2")
    near = F.lit(True) if tolerance_s is None else F.col("_t") - F.col("_last._t") <= F.lit(round(tolerance_s * 1_000_000))
    out = found.select("_l.*", F.when(near, F.col("_last._r")).alias(name))
    return out.unionByName(left.filter(~whole(time)).withColumn(name, F.lit(None).cast(out.schema[name].dataType)))


def long_enough(spans: DataFrame, windows: float = 2.0) -> DataFrame:
    """One row, ``long_enough``: whether all windows together last at least so many times their
    mean length; null without windows."""
    seconds = lambda c: F.unix_micros(c.cast("timestamp_ltz")) / 1e6
    whole = seconds(F.max("endtime")) - seconds(F.min("starttime"))
    return spans.agg((whole >= windows * F.avg(seconds(F.col("endtime")) - seconds(F.col("starttime")))).alias("long_enough"))


def sample_bounds(spans: DataFrame, rate: float) -> DataFrame:
    """Windows with ``last_instant``, a microsecond before their end, and ``last_sample``."""
    end = F.col("endtime")
    return spans.withColumn("last_instant", end - F.expr("interval 1 microsecond")).withColumn("last_sample", end - F.expr(f"interval {round(1e6 / rate)} microseconds"))
