"""Data chunks from records: slices by window, checked, merged and padded; then preprocessed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwave.config import DatachunkParams
from stillwave.functions import traces as T


def _micros(c) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp_ltz"))


def slices(records: DataFrame, spans: DataFrame, keys: list[str], bucket_s: int) -> DataFrame:
    """The part of every record (``keys``, ``starttime``, ``rate``, ``samples``) that lies in
    a window [start, end) of ``spans`` (``timespan_id``, ``starttime``, ``endtime``).

    Records and windows are listed under the buckets of time that they touch and meet in the
    first one that they share; samples are cut out in the JVM. The new ``at`` is the first
    sample's time in microseconds, ``start`` and ``end`` are the window's.
    """
    size = bucket_s * 1_000_000
    r = records.filter("rate > 0 and size(samples) > 0").withColumn("_from", _micros("starttime"))
    r = r.withColumn("_to", F.col("_from") + F.round((F.size("samples") - 1) / F.col("rate") * 1e6).cast("long"))
    s = spans.select("timespan_id", _micros("starttime").alias("start"), _micros("endtime").alias("end"))
    listed = lambda df, a, b: df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))))
    met = listed(r, "_from", "_to").join(listed(s, "start", "end"), "_bucket")
    met = met.filter((F.col("_from") < F.col("end")) & (F.col("_to") >= F.col("start")))
    met = met.filter(F.col("_bucket") == F.floor(F.greatest("_from", "start") / size))
    # The first sample at or after the start, and the last one before the end.
    step = F.lit(1e6) / F.col("rate")
    first = F.greatest(F.lit(0), F.ceil((F.col("start") - F.col("_from")) / step - T.JITTER)).cast("int")
    last = F.least(F.size("samples") - 1, F.ceil((F.col("end") - F.col("_from")) / step - T.JITTER) - 1).cast("int")
    met = met.withColumn("_first", first).withColumn("_last", last).filter("_last >= _first")
    return met.select(
        *keys, "timespan_id", "start", "end", "rate", (F.col("_from") + F.round(F.col("_first") * step).cast("long")).alias("at"),
        F.slice("samples", F.col("_first") + 1, F.col("_last") - F.col("_first") + 1).alias("samples"),
    )


def chunks(records: DataFrame, spans: DataFrame, keys: list[str], params: DatachunkParams, rate: float, bucket_s: int = 3600) -> DataFrame:
    """What :func:`filled` makes of the records' slices."""
    return filled(slices(records, spans, keys, bucket_s), keys, params, rate)


def filled(sliced: DataFrame, keys: list[str], params: DatachunkParams, rate: float) -> DataFrame:
    """One row for each key and window with any samples: ``samples`` that fill the window,
    ``deficit`` (how many were missing) and, where they can't, null samples and a ``problem``.

    A group holds one window of one channel, so it is as large as the window is long.
    """
    kinds = [sliced.schema[k].dataType.simpleString() for k in keys]

    def run(group: pa.Table) -> pa.Table:
        parts = [T.Trace(at / 1e6, r, np.array(x)) for at, r, x in zip(*(group[c].to_pylist() for c in ("at", "rate", "samples")), strict=True)]
        start, end = group["start"][0].as_py() / 1e6, group["end"][0].as_py() / 1e6
        samples = deficit = problem = None
        try:
            whole, deficit = T.prepare(
                parts, start, end, rate, params.datachunk_sample_tolerance, params.max_gap_for_merging, params.zero_padding_method,
                params.padding_taper_max_length, params.padding_taper_max_percentage,
            )
            samples = whole.samples
        except T.TraceError as e:
            problem = str(e)
        columns = [group[k].slice(0, 1) for k in [*keys, "timespan_id"]]
        return pa.table(
            [*columns, pa.array([samples], pa.list_(pa.float64())), pa.array([deficit], pa.int64()), pa.array([problem], pa.string())], names=[*keys, "timespan_id", "samples", "deficit", "problem"]
        )

    schema = ", ".join([*(f"{k} {t}" for k, t in zip(keys, kinds, strict=True)), "timespan_id long, samples array<double>, deficit long, problem string"])
    return sliced.groupBy(*keys, "timespan_id").applyInArrow(run, schema)
