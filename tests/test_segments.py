"""Runs, triggers and gaps over segments against one pass over each key's whole sequence."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillwave.operators import chunks, segments


def sequences(seed, n=400):
    """Rows of three keys (one null, one with most rows), whose values stay for a while."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        key = None if rng.random() < 0.1 else "hot" if rng.random() < 0.8 else "other"
        kind = rng.random()
        out.append((i, key, None if kind < 0.05 else float(rng.integers(0, 10) if kind < 0.4 else (i // 40) % 2 * 9)))
    return out


def by_key(rows):
    held = {}
    for i, key, v in rows:
        held.setdefault(key, []).append((i, v))
    return held


@pytest.mark.parametrize("size", [1, 3, 17, 1000])
@pytest.mark.parametrize("seed", [0, 1])
def test_segments_equal_one_pass(spark, size, seed):
    rows = sequences(seed)
    df = spark.createDataFrame(rows, "i long, k string, v double").repartition(4).withColumn("part", F.floor(F.col("i") / size))
    states, starts = {}, []
    for key, held in by_key(rows).items():
        on, last = False, None
        run = None
        for i, v in held:
            before = last
            last = v if v is not None else last
            on = True if v is not None and v > 7 else False if v is not None and v <= 3 else on
            states[i] = (on, last, before)
            if on:
                run = [i, i, 1, v or 0.0] if run is None else [run[0], i, run[2] + 1, max(run[3], v or 0.0)]
            elif run:
                starts.append((key, *run))
                run = None
        starts += [(key, *run)] if run else []
    active = segments.hysteresis(df, ["k"], "part", ["i"], "v", 7.0, 3.0)
    active = segments.filled(active, ["k"], "part", ["i"], F.col("v"), "last")
    active = segments.filled(active, ["k"], "part", ["i"], F.col("v"), "before", strictly=True)
    assert {r.i: (r.active, r["last"], r.before) for r in active.collect()} == states
    measures = {"first": ("min", F.col("i")), "until": ("max", F.col("i")), "most": ("max", F.coalesce("v", F.lit(0.0)))}
    found = segments.runs(active, ["k"], "part", ["i"], "active", measures)
    assert sorted(((r.k, r["first"], r.until, r.length, r.most) for r in found.collect()), key=str) == sorted(starts, key=str)


def test_runs_as_by_one_window(spark):
    df = spark.createDataFrame([(i, i % 3, i % 11 < 7) for i in range(500)], "i long, g long, f boolean").withColumn("part", F.floor(F.col("i") / 50))
    one = sorted((r.g, r.length, r["first"], r["last"]) for r in chunks.run_lengths(df, ["g"], "i", "f").collect())
    many = segments.runs(df, ["g"], "part", ["i"], "f", {"first": ("min", F.col("i")), "last": ("max", F.col("i"))})
    assert sorted((r.g, r.length, r["first"], r["last"]) for r in many.collect()) == one
    assert segments.runs(df.filter("false"), ["g"], "part", ["i"], "f").count() == 0
    assert [tuple(r) for r in segments.runs(df.withColumn("f", F.lit(True)).withColumn("g", F.lit(1)), ["g"], "part", ["i"], "f").collect()] == [(1, 500)]
    with pytest.raises(ValueError):
        segments.hysteresis(df, ["g"], "part", ["i"], "i", 1.0, 2.0)


def test_no_window_holds_a_whole_key(spark):
    """One key has all rows: the rows' windows are of a key and segment, and only the segments'
    rows meet by key."""
    df = spark.range(10_000).select(F.lit("a").alias("k"), "id", (F.col("id") % 7 > 2).alias("f"), F.floor(F.col("id") / 100).alias("part"))
    plan = segments.runs(df, ["k"], "part", ["id"], "f")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window " in line or "Window [" in line]
    rows = [line for line in windows if "_seg_n" in line or "_seg_run" in line]
    assert rows and all("part#" in line.split("], [")[1] for line in rows)
