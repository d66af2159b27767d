"""Instruments' responses by epoch, joined to chunks and taken off them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwave.functions import dsp

CHANNEL = ["network", "station", "location", "channel"]


def with_epoch(chunks: DataFrame, epochs: DataFrame, key: list[str] = CHANNEL, time: str = "starttime", name: str = "epoch") -> DataFrame:
    """Chunks with ``name``, the epoch of their channel in which they begin (a struct of the other
    columns of ``epochs``): start_date <= time < end_date, where a null start or end is open.
    Of several the one that began last counts (then the one that ends last, an open one
    latest of all); without any, or with a null key or time, it is null.

    A channel's epochs, of which there are few, are one row, so chunks meet one row each and
    their samples aren't multiplied; Spark sends the epochs around if they are small.
    """
    far = F.lit("9999-12-31").cast("timestamp_ntz")
    rest = [c for c in epochs.columns if c not in key]
    order = [F.coalesce("start_date", F.lit("0001-01-01").cast("timestamp_ntz")).alias("_from"), F.coalesce("end_date", far).alias("_until")]
    by = epochs.groupBy(*key).agg(F.collect_list(F.struct(*order, F.struct(*rest).alias("_e"))).alias("_epochs"))
    at = F.col(time)
    found = F.array_max(F.filter("_epochs", lambda e: (e["_from"] <= at) & ((at < e["_until"]) | (e["_until"] == far))))
    return chunks.join(by, key, "left").withColumn(name, found["_e"]).drop("_epochs")


@lru_cache(maxsize=256)
def _stages(text: str) -> tuple[list[dict], str]:
    epoch = json.loads(text)
    return epoch["stages"], epoch.get("unit") or "M/S"


def without_response(chunks: DataFrame, epochs: DataFrame, rate: float, key: list[str] = CHANNEL, time: str = "starttime", samples: str = "samples", taper_share: float = 0.05, water_db: float = 60.0, sensitivity_only: bool = False) -> DataFrame:
    """Chunks with ``samples`` as velocity of the ground, and ``problem``: null, or why there is none.

    The response is that of the epoch (:func:`with_epoch`) in which a chunk begins, all stages in
    a row; an epoch without stages has its sensitivity as a flat one. With
    ``sensitivity_only`` samples are divided by the sensitivity alone. Without an epoch, or a
    response in it, and where a stage can't be computed, samples are null and the problem says
    so; other chunks aren't affected. Null samples stay null, empty ones empty. Other
    columns stay as they are.
    """
    columns = [c for c in chunks.columns if c not in (samples, "problem")]
    met = with_epoch(chunks, epochs, key, time, "_epoch")
    described = F.to_json(F.struct(F.col("_epoch.stages").alias("stages"), F.col("_epoch.unit").alias("unit")), {"ignoreNullFields": "true"})
    has = F.size(F.coalesce("_epoch.stages", F.array())) > 0
    problem = F.when(F.col("_epoch").isNull(), "no epoch").when(~(has & F.lit(not sensitivity_only)) & ~(F.coalesce("_epoch.sensitivity", F.lit(0.0)) != 0), "no response")
    values = F.col(samples).cast("array<double>")
    names = [f"_c{i}" for i in range(len(columns))]
    rows = met.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True)), values.alias("_x"), problem.alias("_problem"), F.when(has & F.lit(not sensitivity_only), described).alias("_stages"), F.col("_epoch.sensitivity").alias("_flat"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = [None] * batch.num_rows
            problems = batch.column("_problem").to_pylist()
            texts, flats = batch.column("_stages").to_pylist(), batch.column("_flat").to_pylist()
            for i, value in enumerate(batch.column("_x")):
                if problems[i] is not None or not value.is_valid:
                    continue
                x = value.values.to_numpy(zero_copy_only=False).astype(float)
                try:
                    if not len(x):
                        out[i] = x
                    elif texts[i] is None:
                        out[i] = x / flats[i]
                    else:
                        stages, unit = _stages(texts[i])
                        out[i] = dsp.divide_response(x, rate, lambda f, s=stages, u=unit: dsp.stages_response(s, f, u), taper_share, water_db)
                except ValueError as e:
                    problems[i] = str(e)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(out, pa.list_(pa.float64())), pa.array(problems, pa.string())], [*names, "_y", "_why"])

    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    out = rows.mapInArrow(run, f"{schema}, _y array<double>, _why string")
    return out.select(*(F.col(n).alias(c) for c, n in zip(columns, names, strict=True)), F.col("_y").alias(samples), F.col("_why").alias("problem"))
