"""A poisoned item in every step of the jobs: quarantined, and nothing else changes."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillwave import config
from stillwave.operators import jobs, signals, snapshots
from stillwave.operators.quarantine import ItemError, Quarantine

KEY = "component_id long, timespan_id long"
RATE = 8.0
AT = dt.datetime(2020, 3, 1)


@pytest.fixture(scope="module")
def chunks(spark):
    """Three components of two windows; one chunk more that has a NaN, one a null inside, one an infinity."""
    rng = np.random.default_rng(3)
    good = [(c, k, rng.standard_normal(240).tolist()) for c in (1, 2, 3) for k in range(2)]
    nan, hole, far = (rng.standard_normal(240).tolist() for _ in range(3))
    nan[7], hole[9], far[3] = float("nan"), None, float("inf")
    schema = f"{KEY}, samples array<double>"
    return spark.createDataFrame(good, schema), spark.createDataFrame([*good, (4, 0, nan), (4, 1, hole), (5, 0, far), (5, 1, None)], schema)


BAD = {(4, 0), (4, 1), (5, 0), (5, 1)}


def items(quarantine, step):
    found = quarantine.table().filter(F.col("step") == step).select(F.from_json("item", KEY).alias("k"), "problem").select("k.*", "problem").collect()
    return {(r.component_id, r.timespan_id): r.problem for r in found}


def plain(df):
    return sorted((str(r) for r in df.collect()))


BEAMS = config.BeamformingParams(min_freq=0.5, max_freq=2.0, slowness_step=0.25, window_length=10.0, window_step_fraction=1.0)
STEPS = {
    "statistics": lambda s, d, q: jobs.statistics(d, s.createDataFrame([], f"{KEY}, energy double, mean double"), quarantine=q),
    "processed": lambda s, d, q: jobs.processed(d, s.createDataFrame([], f"{KEY}, samples array<double>"), config.ProcessedDatachunkParams(filtering_low=0.5), RATE, quarantine=q),
    "crosscorrelations": lambda s, d, q: jobs.crosscorrelations(d, s.createDataFrame([(a, b) for a in range(1, 6) for b in range(a, 6)], "component_id_a long, component_id_b long"), s.createDataFrame([], "component_id_a long, component_id_b long, timespan_id long, ccf array<double>"), 4, quarantine=q),
    "power_spectra": lambda s, d, q: jobs.power_spectra(d, s.createDataFrame([], f"{KEY}, mean array<double>, std array<double>, segments long"), config.PPSDParams(segment_length=10.0, segment_step=5.0, freq_min=0.5, freq_max=3.0, sampling_rate=RATE), quarantine=q),
    "events": lambda s, d, q: jobs.events(d, s.createDataFrame([], KEY), config.EventDetectionParams(detection_type="amplitude_spike", peak_ground_velocity_threshold=2.0), RATE, quarantine=q)[0],
    "beams": lambda s, d, q: jobs.beams(d, s.createDataFrame([(c, c * 0.7, c * c * 0.3) for c in range(1, 6)], "component_id long, px double, py double"), s.createDataFrame([], signals.beam_peaks(d.selectExpr("timespan_id", "component_id vec_id", "samples x", "0D px", "0D py"), BEAMS, RATE).schema), BEAMS, RATE, quarantine=q),
    "preprocessed": lambda s, d, q: jobs.preprocessed(d, s.createDataFrame([(k, AT, AT + dt.timedelta(seconds=30)) for k in range(2)], "timespan_id long, starttime timestamp_ntz, endtime timestamp_ntz"), None, s.createDataFrame([], f"{KEY}, samples array<double>"), config.DatachunkParams(sampling_rate=4.0, prefiltering_low=0.2, prefiltering_high=1.5), RATE, quarantine=q),
}


@pytest.mark.parametrize("step", sorted(STEPS))
def test_poisoned_chunks(spark, chunks, step):
    good, all_of_them = chunks
    quarantine = Quarantine(spark)
    assert plain(STEPS[step](spark, all_of_them, quarantine)) == plain(STEPS[step](spark, good, None))
    assert set(items(quarantine, step)) == BAD and items(quarantine, step)[5, 1] == "no samples"
    with pytest.raises(ItemError, match="samples"):
        STEPS[step](spark, all_of_them, Quarantine(spark, "raise"))


def test_poisoned_correlations(spark):
    rows = [(1, 2, k, [float(k), 1.0, 2.0]) for k in range(4)] + [(1, 2, 4, [float("nan")] * 3), (1, 3, 0, [1.0, None, 2.0])]
    schema = "component_id_a long, component_id_b long, timespan_id long, ccf array<double>"
    at = lambda k: AT + dt.timedelta(hours=k)
    spans = spark.createDataFrame([(k, at(k), at(k + 1)) for k in range(6)], "timespan_id long, starttime timestamp_ntz, endtime timestamp_ntz")
    stack = spark.createDataFrame([(0, at(0), at(6))], "stack_id long, stack_start timestamp_ntz, stack_end timestamp_ntz")
    none = spark.createDataFrame([], "component_id_a long, component_id_b long, stack_id long, stack array<double>, no_ccfs long")
    quarantine = Quarantine(spark)
    found = jobs.stacks(spark.createDataFrame(rows, schema), spans, stack, none, 1, quarantine=quarantine).collect()
    assert [(r.component_id_b, r.no_ccfs, r.stack) for r in found] == [(2, 4, [1.5, 1.0, 2.0])]
    assert sorted(r.item for r in quarantine.table().collect()) == ['{"component_id_a":1,"component_id_b":2,"timespan_id":4}', '{"component_id_a":1,"component_id_b":3,"timespan_id":0}']


def test_a_kernel_that_fails_on_one_trace(spark):
    """A filter whose corner is beyond the rate fails on all; a trace that overflows on that one."""
    rows = [(1, 1, [1e308, -1e308] * 60), (2, 1, np.random.default_rng(0).standard_normal(120).tolist())]
    df = spark.createDataFrame(rows, f"{KEY}, samples array<double>")
    none, params = spark.createDataFrame([], df.schema), config.ProcessedDatachunkParams(filtering_low=0.5, one_bit=False)
    quarantine = Quarantine(spark)
    found = jobs.processed(df, none, params, RATE, quarantine=quarantine)
    assert [r.component_id for r in found.collect()] == [2] and set(items(quarantine, "processed")) == {(1, 1)}
    quarantine = Quarantine(spark)
    assert jobs.processed(df, none, params, 4.0, quarantine=quarantine).count() == 0
    assert {p.split(":")[0] for p in items(quarantine, "processed").values()} == {"ValueError"} and len(items(quarantine, "processed")) == 2
    with pytest.raises(ItemError, match="ValueError"):
        jobs.processed(df, none, params, 4.0, quarantine=Quarantine(spark, "raise"))
    assert Quarantine(spark).table().count() == 0
    with pytest.raises(ValueError):
        Quarantine(spark, "ignore")


def test_problems_of_chunks_and_committed_results(spark, tmp_path):
    records = spark.createDataFrame([(1, AT, RATE, [1.0] * 480), (2, AT, RATE, [1.0] * 10)], "component_id long, starttime timestamp_ntz, rate double, samples array<double>")
    spans = spark.createDataFrame([(0, AT, AT + dt.timedelta(seconds=60))], "timespan_id long, starttime timestamp_ntz, endtime timestamp_ntz")
    schema = f"{KEY}, samples array<double>, deficit long"
    quarantine = Quarantine(spark)
    found = jobs.datachunks(records, spans, spark.createDataFrame([], schema), config.DatachunkParams(), RATE, quarantine=quarantine)
    assert [(r.component_id, r.deficit) for r in found.collect()] == [(1, 0)] and set(items(quarantine, "datachunks")) == {(2, 0)}
    kept = snapshots.Snapshots.create(spark, str(tmp_path / "problems"), "step string, item string, problem string", ["step", "item"], buckets=2)
    kept.upsert(quarantine.table())
    assert kept.read().count() == 1
    table = snapshots.Snapshots.create(spark, str(tmp_path / "squares"), "k long, y long", ["k"], buckets=2)
    work = spark.range(6).select(F.col("id").alias("k"))
    seen = []
    compute = lambda new: (seen.append(new.count()), new.select("k", (F.col("k") * F.col("k")).alias("y")))[1]
    assert [jobs.committed(table, part, ["k"], compute) for part in (work.filter("k < 4"), work, work)] == [1, 2, 2]
    assert seen == [4, 2, 0] and sorted(map(tuple, table.read().collect())) == [(k, k * k) for k in range(6)]
