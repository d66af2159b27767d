"""Statistics and quality verdicts of data chunks, incremental filters and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillwave.functions import columns as C

METRICS = ("energy", "min", "max", "mean", "variance", "skewness", "kurtosis")


def statistics(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Energy (mean square), extremes, mean, variance (n - 1), biased skewness and excess
    kurtosis of each group, in one pass with partial aggregation."""
    x = F.col(value)
    return samples.groupBy(*keys).agg(
        F.count(x).alias("npts"), (F.sum(x * x) / F.count(x)).alias("energy"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"),
    )


def array_statistics(x: Column) -> dict[str, Column]:
    """The same of an array column, without exploding it."""
    n = F.size(x).cast("double")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    mean = total(x) / n
    power = lambda k: F.aggregate(x, F.lit(0.0), lambda s, v: s + F.pow(v - mean, F.lit(float(k)))) / n
    return {
        "energy": F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / n, "min": F.array_min(x), "max": F.array_max(x),
        "mean": mean, "variance": power(2) * n / (n - 1), "skewness": power(3) / F.pow(power(2), F.lit(1.5)), "kurtosis": power(4) / F.pow(power(2), F.lit(2.0)) - 3.0,
    }


def bounds_verdicts(bounds: dict[str, float | None], policy: bool, inverted: bool = False) -> list[Column]:
    """``<metric>_min`` and ``<metric>_max`` verdicts; a missing statistic or bound gives
    the policy's value. ``inverted`` is the historic direction, with the sides swapped."""
    out = []
    for name, bound in bounds.items():
        metric, side = name.rsplit("_", 1)
        op = {"min": ">=", "max": "<="}[side]
        if inverted:
            op = {">=": "<=", "<=": ">="}[op]
        out.append(C.compare_null_safe(F.col(metric), F.lit(bound).cast("double"), op, policy).alias(f"ok_{name}"))
    return out


def time_verdicts(start: Column, end: Column, policy: bool = False) -> list[Column]:
    """Whether a window lies within the accepted period, null-safe at either end."""
    within = lambda test: F.coalesce(test, F.lit(policy))
    return [within(start <= F.col("starttime")).alias("ok_starttime"), within(end >= F.col("endtime")).alias("ok_endtime")]


def passing(names: list[str]) -> Column:
    """Whether all verdicts are true."""
    return reduce(lambda a, b: a & b, [F.col(n) for n in names]).alias("is_passing")


def outside_rejected(chunks: DataFrame, periods: DataFrame, key: str | list[str]) -> DataFrame:
    """Chunks with ``ok_accepted_time``: false where the chunk overlaps a rejected period
    of its component, ends included; a join on the component, whose side Spark sends around only
    if it is small."""
    p = periods.select(*([key] if isinstance(key, str) else key), F.col("starttime").alias("_s"), F.col("endtime").alias("_e"))
    hit = chunks.join(p, key).filter(C.overlaps(F.col("starttime"), F.col("endtime"), F.col("_s"), F.col("_e")))
    hit = hit.select("chunk_id").distinct().withColumn("_hit", F.lit(True))
    return chunks.join(hit, "chunk_id", "left").withColumn("ok_accepted_time", F.col("_hit").isNull()).drop("_hit")


def with_gps(chunks: DataFrame, gps: DataFrame, on: list[str], strict: bool) -> DataFrame:
    """Chunks with their averaged GPS row; without one they stay with nulls unless strict."""
    return chunks.join(gps, on, "inner" if strict else "left")


def not_done(work: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Work without a result yet."""
    return work.join(done.select(*key).distinct(), key, "left_anti")


def passed_only(work: DataFrame, verdicts: DataFrame, key: list[str]) -> DataFrame:
    """Work whose verdict is known and passing."""
    return work.join(verdicts.filter("is_passing").select(*key), key, "left_semi")


def upsert(existing: DataFrame, new: DataFrame, key: list[str], nothing_on_conflict: bool = False) -> DataFrame:
    """The table after an insert that updates rows of an equal key, or leaves them. Of new
    rows that share a key the one with the largest values, column by column, counts."""
    rest = [c for c in existing.columns if c not in key]
    new = new.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_r")).select(*key, "_r.*") if rest else new.select(*key).distinct()
    if nothing_on_conflict:
        return existing.unionByName(new.join(existing.select(*key), key, "left_anti").select(*existing.columns))
    return existing.join(new.select(*key), key, "left_anti").select(*existing.columns).unionByName(new.select(*existing.columns))


def next_id(df: DataFrame, column: str, step: int = 1) -> DataFrame:
    """The largest value and ``step``; 1 for an empty table."""
    return df.agg(F.coalesce(F.max(column) + F.lit(step), F.lit(1)).cast("long").alias("next_id"))


def run_lengths(df: DataFrame, by: list[str], order: str, flag: str) -> DataFrame:
    """Lengths of the runs of consecutive true flags, with each run's first and last place."""
    w = Window.partitionBy(*by).orderBy(order)
    islands = df.withColumn("_k", F.row_number().over(w) - F.sum(F.col(flag).cast("int")).over(w)).filter(F.col(flag))
    return islands.groupBy(*by, "_k").agg(F.count("*").alias("length"), F.min(order).alias("first"), F.max(order).alias("last")).drop("_k")


def numbered(df: DataFrame, by: list[str], part: str, order: list[str], name: str) -> DataFrame:
    """``name``: each row's place from 1 within its key, in the order of ``part`` (a day, say)
    and then of ``order``.

    Rows are sorted by key and part, so a key with many rows is as many pieces of work as it
    has parts; a part begins where the counts of the key's earlier parts, one row each, end.
    Nulls sort first; rows equal in all of these are placed in any order.
    """
    key = [*by, part]
    counts = df.groupBy(*key).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(F.col(c).alias(f"_{c}") for c in key), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
    return within.join(starts, same).withColumn(name, F.col(name) + F.col("_before")).drop("_before", *(f"_{c}" for c in key))
