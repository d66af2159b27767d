"""Correlations in blocks of a window, processing by its parameters, results brought up to date."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillwave import config
from stillwave.functions import dsp
from stillwave.operators import chunks as chunk_columns
from stillwave.operators import jobs, signals, stacking

KEY = ["component_id_a", "component_id_b", "timespan_id"]
NONE = "component_id_a long, component_id_b long, timespan_id long, ccf array<double>"


def chunks(spark, components, windows, n=40, seed=0):
    rng = np.random.default_rng(seed)
    data = {(c, k): rng.standard_normal(n) for c in range(components) for k in range(windows)}
    return data, spark.createDataFrame([(c, k, x.tolist()) for (c, k), x in data.items()], "component_id long, timespan_id long, samples array<double>")


def all_pairs(spark, components):
    return spark.createDataFrame([(a, b) for a in range(components) for b in range(a, components)], "component_id_a long, component_id_b long")


def written_bytes(spark, df):
    """Bytes that the stages of a run wrote to the shuffle."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = lambda: store.stageList(None, False, False, none, None)
    total = lambda: sum((lambda all: [all.apply(i).shuffleWriteBytes() for i in range(all.size())])(stages()))
    before = total()
    df.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return total() - before


@pytest.mark.parametrize("block", [1, 5, 100])
def test_blocks_agree_with_pairs(spark, block):
    data, held = chunks(spark, 13, 3)
    pairs = all_pairs(spark, 13)
    todo = pairs.crossJoin(spark.range(3).select(F.col("id").alias("timespan_id")))
    found = signals.block_correlations(held, todo, 7, block=block).collect()
    assert len(found) == 13 * 14 // 2 * 3
    for r in found:
        assert r.ccf == pytest.approx(dsp.correlate(data[r.component_id_a, r.timespan_id], data[r.component_id_b, r.timespan_id], 7).tolist(), abs=1e-12)


def test_blocks_of_odd_chunks(spark):
    rows = [(1, 0, [1.0, 2.0, 0.5]), (2, 0, [1.0, 2.0]), (3, 0, None), (4, 0, []), (5, 0, [0.0, 0.0, 0.0]), (6, 0, [3.0, 1.0, 1.0]), (6, 0, [1.0, 1.0, 1.0]), (None, 0, [1.0] * 3), (7, None, [1.0] * 3)]
    held = spark.createDataFrame(rows, "component_id long, timespan_id long, samples array<double>").withColumns({c: F.lit("x") for c in ("_i", "_j", "_to", "ccf")})
    pairs = [(a, b, 0) for a in (1, 2, 3, 4, 5, 6, 8) for b in (1, 5, 6)] + [(1, None, 0), (7, 7, None), (1, 6, 0)]
    todo = spark.createDataFrame(pairs, "component_id_a long, component_id_b long, timespan_id long").withColumn("_i", F.lit("x"))
    found = signals.block_correlations(held, todo, 1, block=2).collect()
    got = sorted((r.component_id_a, r.component_id_b) for r in found)
    assert got == sorted([(a, b) for a in (1, 5, 6) for b in (1, 5, 6)] + [(1, 6)])
    six = [r.ccf for r in found if (r.component_id_a, r.component_id_b) == (1, 6)]
    assert six[0] == six[1] == pytest.approx(dsp.correlate(np.array([1.0, 2.0, 0.5]), np.array([3.0, 1.0, 1.0]), 1))
    assert signals.block_correlations(held, todo.filter("false"), 1).count() == 0


def test_blocks_move_fewer_bytes_and_finished_work_none(spark, tmp_path):
    """As many components as make copies for each pair dear: the shuffle grows with chunks times
    blocks. On a second run nothing is left to do, and no samples are shuffled."""
    _, held = chunks(spark, 24, 4, n=600)
    held.write.parquet(str(tmp_path / "chunks"))
    held, pairs = spark.read.parquet(str(tmp_path / "chunks")), all_pairs(spark, 24)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        side = lambda s: held.select(F.col("component_id").alias(f"component_id_{s}"), "timespan_id", F.col("samples").alias(f"x_{s}"))
        copied = pairs.join(side("a"), "component_id_a").join(side("b"), ["component_id_b", "timespan_id"]).repartition(4, "timespan_id")
        none = spark.createDataFrame([], NONE)
        first = jobs.crosscorrelations(held, pairs, none, 5)
        by_pair, by_block = written_bytes(spark, copied), written_bytes(spark, first)
        first.write.parquet(str(tmp_path / "ccfs"))
        again = written_bytes(spark, jobs.crosscorrelations(held, pairs, spark.read.parquet(str(tmp_path / "ccfs")), 5))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    samples = 24 * 4 * 600 * 8
    assert by_pair > 8 * samples and by_block < 3.5 * samples, (by_pair, by_block, samples)
    assert again < by_block


# Processing


def reference_whitened(x, rate, p):
    """Both branches by loops over frequencies, from the parameters."""
    n, low, high = len(x), p.filtering_low, p.filtering_high
    width = min(n // 2, int(rate / low))
    window = np.ones(n)
    for i in range(width):
        window[i] *= 0.5 - 0.5 * np.cos(2 * np.pi * i / (2 * width - 1))
        window[n - 1 - i] *= 0.5 - 0.5 * np.cos(2 * np.pi * i / (2 * width - 1))
    s = np.fft.fft(x * window)
    most = np.abs(s).max()
    level = np.array([np.abs(v) if k == 0 else max(np.abs(v), p.waterlevel_ratio_to_max * most) for k, v in enumerate(s)])
    if not p.quefrency:
        return np.fft.ifft(s / level).real
    log = np.log(level)
    least = log.min()
    hertz = min(p.convolution_sliding_window_ratio_to_bandwidth * (high - low), low * p.convolution_sliding_window_max_ratio_to_fmin)
    l_conv = round(max(p.convolution_sliding_window_min_samples, hertz / (rate / 2) * n))
    mean = np.convolve((log - least)[1:], np.ones(l_conv), mode="same") / l_conv
    even = np.concatenate([(log - least)[:1], (mean + mean[::-1]) / 2])
    keep, fall = round(n * p.quefrency_filter_lowpass_pct / 2), max(p.quefrency_filter_taper_min_samples, round(n * p.quefrency_filter_taper_length_ratio_to_length_cepstrum))
    sine = lambda i, w: np.sin(min(1, max(0, i / (w - 1))) * np.pi / 2) ** 2
    cepstrum = np.fft.fft(even)
    for j in range(n):
        q = min(j, n - j)
        cepstrum[j] *= 1.0 if q <= keep else sine(fall - 1 - (q - keep), fall)
    smooth = np.exp(np.fft.ifft(cepstrum).real + least)
    axis = np.linspace(0, rate / 2, round(n / 2))
    first, last = np.argmin(np.abs(axis - low)), np.argmin(np.abs(axis - high))
    band = np.array([sine(min(j, n - j) - first + l_conv - 1, l_conv) * sine(last + l_conv - 1 - min(j, n - j), l_conv) for j in range(n)])
    return np.fft.ifft(s / smooth * band).real


PARAMS = config.ProcessedDatachunkParams(filtering_low=1.0, filtering_high=8.0, waterlevel_ratio_to_max=0.05, convolution_sliding_window_min_samples=4, quefrency_filter_taper_min_samples=6, one_bit=False, quefrency=True)


def processed(spark, x, params, rate=32.0):
    df = spark.createDataFrame([(1, 1, x.tolist())], "component_id long, timespan_id long, samples array<double>")
    return np.array(jobs.processed(df, spark.createDataFrame([], df.schema), params, rate).first().samples)


@pytest.mark.parametrize("quefrency", [False, True])
@pytest.mark.parametrize("n", [400, 401])
def test_whitening_by_loops(quefrency, n):
    p = dataclasses.replace(PARAMS, quefrency=quefrency)
    x = np.cumsum(np.random.default_rng(n).standard_normal(n))
    smooth = {"min_samples": 4, "ratio_to_bandwidth": 0.15, "max_ratio_to_low": 0.5, "lowpass": 0.5, "taper_samples": 6, "taper_ratio": 0.01}
    got = dsp.whitened(np.stack([x, x * 2]), 32.0, 1.0, 8.0, 0.05, smooth if quefrency else None)
    assert got[0] == pytest.approx(reference_whitened(x, 32.0, p), abs=1e-9) and got[1] == pytest.approx(got[0], abs=1e-9)
    assert not dsp.whitened(np.zeros(n), 32.0, 1.0, 8.0, 0.05, smooth).any()


@pytest.mark.parametrize("change", [
    {"spectral_whitening": False}, {"one_bit": True}, {"quefrency": False}, {"filtering_order": 2}, {"filtering_low": 2.0}, {"filtering_high": 6.0}, {"waterlevel_ratio_to_max": 0.3},
    {"convolution_sliding_window_min_samples": 40}, {"convolution_sliding_window_max_ratio_to_fmin": 0.1}, {"convolution_sliding_window_ratio_to_bandwidth": 0.01},
    {"quefrency_filter_lowpass_pct": 0.1}, {"quefrency_filter_taper_min_samples": 60}, {"quefrency_filter_taper_length_ratio_to_length_cepstrum": 0.2},
], ids=lambda c: next(iter(c)))
def test_every_parameter_acts(spark, change):
    x = np.cumsum(np.random.default_rng(7).standard_normal(400))
    p = dataclasses.replace(PARAMS, **change)
    y = reference_whitened(x, 32.0, p) if p.spectral_whitening else x
    y = dsp.bandpass(y, p.filtering_low, p.filtering_high, 32.0, p.filtering_order)
    y = np.sign(y) if p.one_bit else y
    got = processed(spark, x, p)
    assert got == pytest.approx(y, abs=1e-9) and np.abs(got - processed(spark, x, PARAMS)).max() > 1e-6


# Results brought up to date


@pytest.mark.parametrize("digest", [False, True])
def test_a_late_window_changes_its_stack(spark, digest):
    import datetime as dt

    at = lambda k: dt.datetime(2020, 1, 1) + dt.timedelta(hours=k)
    rng = np.random.default_rng(1)
    data = {k: rng.standard_normal(5) for k in range(12)}
    ccfs = spark.createDataFrame([(1, 2, k, x.tolist()) for k, x in data.items()] + [(1, 3, 0, [1.0] * 5), (1, 3, 1, None)], NONE)
    spans = spark.createDataFrame([(k, at(k), at(k + 1)) for k in range(12)], "timespan_id long, starttime timestamp_ntz, endtime timestamp_ntz")
    days = spark.createDataFrame([(s, at(6 * s), at(6 * s + 6)) for s in range(2)], "stack_id long, stack_start timestamp_ntz, stack_end timestamp_ntz")
    none = spark.createDataFrame([], "component_id_a long, component_id_b long, stack_id long, stack array<double>, no_ccfs long" + ", inputs long" * digest)
    kept = lambda df: spark.createDataFrame(df.collect(), df.schema)
    table = kept(jobs.stacks(ccfs.filter("timespan_id < 5"), spans, days, none, 3))
    assert [(r.stack_id, r.no_ccfs) for r in table.collect()] == [(0, 5)]
    table = kept(jobs.stacks(ccfs, spans, days, table, 3))
    got = {r.stack_id: r for r in table.collect()}
    assert {s: r.no_ccfs for s, r in got.items()} == {0: 6, 1: 6}
    assert got[0].stack == pytest.approx(np.mean([data[k] for k in range(6)], axis=0))
    todo = jobs.changed(ccfs.filter("ccf is not null").join(spans, "timespan_id").select("component_id_a", "component_id_b", "timespan_id", F.floor(F.col("timespan_id") / 6).alias("stack_id")), table, ["component_id_a", "component_id_b", "stack_id"], "timespan_id", "no_ccfs")
    assert todo.filter("component_id_b = 2").count() == 0
    passing = lambda bad: ccfs.select(*KEY, (~F.col("timespan_id").isin(bad)).alias("is_passing"))
    assert {r.stack_id: r.no_ccfs for r in jobs.stacks(ccfs, spans, days, table, 3, passing([0, 6, 7, 8, 9])).collect()} == {0: 5}
    if digest:
        one = kept(jobs.stacks(ccfs, spans, days, table, 3, passing([0])))
        other = {r.stack_id: r.stack for r in jobs.stacks(ccfs, spans, days, one, 3, passing([1])).collect()}
        assert other[0] == pytest.approx(np.mean([data[k] for k in (0, 2, 3, 4, 5)], axis=0))


def test_late_gps_changes_a_verdict(spark):
    import datetime as dt

    stats = spark.createDataFrame([(1, 1, *[1.0] * 7)], "component_id long, timespan_id long, " + ", ".join(f"{m} double" for m in chunk_columns.METRICS))
    spans = spark.createDataFrame([(1, dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2))], "timespan_id long, starttime timestamp_ntz, endtime timestamp_ntz")
    params = config.QCOneConfig(starttime="2020-01-01", endtime="2020-01-03", avg_gps_time_error_max=1.0, null_treatment_policy="pass")
    gps = spark.createDataFrame([(1, 1, 5.0, 0.0)], "component_id long, timespan_id long, error double, uncertainty double")
    periods = spark.createDataFrame([], "component_id long, starttime timestamp_ntz, endtime timestamp_ntz")
    none = spark.createDataFrame([], "component_id long, timespan_id long, ok_error_max boolean, is_passing boolean")
    first = jobs.qc_one(stats, spans, gps.filter("false"), periods, none, params)
    assert first.first().is_passing
    second = jobs.qc_one(stats, spans, gps, periods, first, params)
    assert [r.is_passing for r in second.collect()] == [False]


def test_sums_are_held_by_samples(spark, monkeypatch):
    monkeypatch.setattr(stacking, "HELD", 50)
    rows = [(i % 30, [float(i), 1.0] if i % 2 else [float(i)] * 40) for i in range(300)]
    found = {r.k: r for r in stacking.linear_stack(spark.createDataFrame(rows, "k long, y array<double>"), ["k"], "y").collect()}
    assert found[3].no_ccfs == 10 and found[3].stack == pytest.approx([np.mean([i for i in range(300) if i % 30 == 3]), 1.0])


# Beams


@pytest.mark.parametrize("which", ["null", "short", "long", "nan"])
@pytest.mark.parametrize("place", [0, 3, 7])
def test_one_odd_trace_leaves_its_window(spark, which, place):
    """A window with one odd trace gives what it gives without it, wherever the trace stands."""
    rng = np.random.default_rng(2)
    x, at = rng.standard_normal((8, 64)), rng.uniform(-1, 1, (8, 2))
    odd = {"null": None, "short": x[place][:10].tolist(), "long": x[place].tolist() + [0.0], "nan": [float("nan")] * 64}[which]
    schema = "timespan_id long, vec_id long, x array<double>, px double, py double"
    rows = [(w, i, odd if w == 1 and i == place else x[i].tolist(), *map(float, at[i])) for w in (1, 2) for i in range(8) if w == 1 or i != place]
    df = spark.createDataFrame(rows, schema)
    params = config.BeamformingParams(min_freq=4.0, max_freq=16.0, slowness_x_min=-0.3, slowness_x_max=0.3, slowness_y_min=-0.3, slowness_y_max=0.3, slowness_step=0.1, window_length=0.5, window_step_fraction=0.5, extract_peaks_average_beamformer_abspower=True)
    for found in (signals.beams(df, 64.0, 2.0, 12.0, [(i - 4) * 0.1 for i in range(9)], "bartlett", 3), signals.beam_peaks(df, params, 64.0)):
        by = {}
        for r in found.collect():
            by.setdefault(r.timespan_id, []).append(tuple(r)[1:])
        assert by[1] == by[2] and len(by[1]) > 0


def test_beams_again_when_a_station_comes(spark):
    rng = np.random.default_rng(4)
    held = spark.createDataFrame([(c, k, rng.standard_normal(64).tolist()) for c in range(6) for k in range(2)], "component_id long, timespan_id long, samples array<double>")
    places = spark.createDataFrame([(c, *map(float, rng.uniform(-1, 1, 2))) for c in range(6)], "component_id long, px double, py double")
    params = config.BeamformingParams(min_freq=4.0, max_freq=16.0, slowness_x_min=-0.3, slowness_x_max=0.3, slowness_y_min=-0.3, slowness_y_max=0.3, slowness_step=0.1, window_length=0.5, window_step_fraction=0.5, extract_peaks_average_beamformer_abspower=True)
    columns = signals.beam_peaks(held.selectExpr("timespan_id", "component_id vec_id", "samples x", "0D px", "0D py"), params, 64.0).schema
    none = spark.createDataFrame([], columns.add("inputs", "long"))
    early = jobs.beams(held.filter("component_id < 4 or timespan_id = 1"), places, none, params, 64.0)
    early = spark.createDataFrame(early.collect(), early.schema)
    late = jobs.beams(held, places, early, params, 64.0)
    key = lambda df, k: sorted(tuple(r)[:-1] for r in df.filter(f"timespan_id = {k}").collect())
    assert key(early, 1) == key(late, 1) and key(early, 0) != key(late, 0) == key(jobs.beams(held, places, none, params, 64.0), 0)


def test_kept_stations_with_odd_traces(spark):
    rng = np.random.default_rng(6)
    rows = [(0, i, (rng.standard_normal(64) * (1000 if i == 5 else 1)).tolist()) for i in range(16)]
    odd = [(0, 100, None), (0, 101, []), (0, 102, [1.0] * 70), (0, 103, [float("nan")] * 64), (1, 104, None)]
    schema = "g long, vec_id long, x array<double>"
    plain = {r.vec_id: r.kept for r in signals.kept_stations(spark.createDataFrame(rows, schema), "g").collect()}
    found = {r.vec_id: r.kept for r in signals.kept_stations(spark.createDataFrame(rows[:3] + odd + rows[3:], schema), "g").collect()}
    assert not plain[5] and found == plain | {i: False for i in range(100, 105)}
