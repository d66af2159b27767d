"""Sequences of a key as bounded segments: what a segment does to what comes before it is told in
one row, and these rows are put together, so that no window holds a key's whole history.

``part`` numbers or dates a key's segments in their order; rows of a segment are sorted by
``order``. A key with most of all rows is as many tasks as it has segments. Null keys are one
key, and columns that begin with ``_seg`` are the functions' own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _joined(df: DataFrame, side: DataFrame, by: list[str]) -> DataFrame:
    """``side``, one row for each key and segment, beside the rows; nulls meet nulls."""
    names = {c: f"_seg_{i}" for i, c in enumerate(by)}
    side = side.withColumnsRenamed(names)
    return df.join(side, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])).drop(*names.values())


def filled(df: DataFrame, by: list[str], part: str, order: list[str], value: Column, name: str, strictly: bool = False) -> DataFrame:
    """``name``: the last value of the key that isn't null, at each row or before it, or, with
    ``strictly``, before it alone. Of a segment others need its last value only."""
    rows = Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strictly else 0)
    held = df.withColumn("_seg_v", value)
    at = F.when(F.col("_seg_v").isNotNull(), F.struct(*order, "_seg_v"))
    ends = held.groupBy(*by, part).agg(F.max(at)["_seg_v"].alias("_seg_end"))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, part, F.last("_seg_end", ignorenulls=True).over(before).alias("_seg_carried"))
    within = held.withColumn("_seg_own", F.last("_seg_v", ignorenulls=True).over(rows))
    return _joined(within, carried, [*by, part]).withColumn(name, F.coalesce("_seg_own", "_seg_carried")).drop("_seg_v", "_seg_own", "_seg_carried")


def hysteresis(df: DataFrame, by: list[str], part: str, order: list[str], ratio: str, on: float, off: float) -> DataFrame:
    """``active``: from a row above ``on`` until one at or below ``off``, which is no larger. To what
    comes before it a segment is one of three maps of the two states: on, off, or as it was,
    as its last deciding row says; composed, the last that isn't the third decides."""
    if off > on:
        raise ValueError("off must not exceed on")
    decided = F.when(F.col(ratio) > on, True).when(F.col(ratio) <= off, False)
    return filled(df, by, part, order, decided, "active").withColumn("active", F.coalesce("active", F.lit(False)))


def runs(df: DataFrame, by: list[str], part: str, order: list[str], flag: str, measures: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """One row for each run of consecutive rows whose flag is true (null is false), over segments'
    bounds: the keys, ``length``, and the measures, each the ``min``, ``max`` or ``sum`` of
    a column over the run.

    Runs are first found in each segment. Those that touch its ends are put together by one row
    for each segment: how it begins and ends, and whether it is one run as a whole.
    """
    measures = measures or {}
    known = {"min": F.min, "max": F.max, "sum": F.sum}
    w = Window.partitionBy(*by, part).orderBy(*order)
    held = df.select(*by, part, *order, F.coalesce(F.col(flag), F.lit(False)).alias("_seg_f"), *(c.alias(f"_seg_m{i}") for i, (_, c) in enumerate(measures.values())))
    place = F.row_number().over(w)
    held = held.withColumn("_seg_n", place).withColumn("_seg_run", F.col("_seg_n") - F.sum(F.col("_seg_f").cast("int")).over(w))
    own = [known[f](f"_seg_m{i}").alias(f"_seg_m{i}") for i, (f, _) in enumerate(measures.values())]
    pieces = held.filter("_seg_f").groupBy(*by, part, "_seg_run").agg(F.count("*").alias("length"), F.min("_seg_n").alias("_seg_first"), F.max("_seg_n").alias("_seg_last"), *own)

    at = F.struct(*order)
    ends = df.select(*by, part, *order, F.coalesce(F.col(flag), F.lit(False)).alias("_seg_f")).groupBy(*by, part).agg(
        F.count("*").alias("_seg_rows"), F.min_by("_seg_f", at).alias("_seg_opens"), F.max_by("_seg_f", at).alias("_seg_closes"), F.bool_and("_seg_f").alias("_seg_whole"))
    along = Window.partitionBy(*by).orderBy(part)
    goes_on = F.coalesce(F.lag("_seg_closes").over(along), F.lit(False)) & F.col("_seg_opens")
    ends = ends.withColumn("_seg_goes_on", goes_on)
    begins = F.when(~(F.col("_seg_whole") & F.col("_seg_goes_on")), F.col(part))
    ends = ends.withColumn("_seg_chain", F.last(begins, ignorenulls=True).over(along)).withColumn("_seg_before", F.lag("_seg_chain").over(along))

    met = _joined(pieces, ends.select(*by, part, "_seg_rows", "_seg_goes_on", "_seg_chain", "_seg_before"), [*by, part])
    chain = F.when((F.col("_seg_first") == 1) & F.col("_seg_goes_on"), F.col("_seg_before")).when(F.col("_seg_last") == F.col("_seg_rows"), F.col("_seg_chain"))
    met = met.withColumn("_seg_to", F.coalesce(chain, F.col(part))).withColumn("_seg_no", F.when(chain.isNull(), F.col("_seg_run")).otherwise(-1))
    together = [known[f](f"_seg_m{i}").alias(name) for i, (name, (f, _)) in enumerate(measures.items())]
    return met.groupBy(*by, "_seg_to", "_seg_no").agg(F.sum("length").alias("length"), *together).drop("_seg_to", "_seg_no")
