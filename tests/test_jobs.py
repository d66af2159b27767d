"""The chain of incremental jobs on a small network, against numpy; every step twice."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillwave import config
from stillwave.functions import dsp
from stillwave.operators import jobs, signals

RATE, LENGTH = 8.0, 60
DAY = dt.datetime(2020, 3, 1)
KEY = "component_id long, timespan_id long"


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def rows(df, *key):
    return {tuple(r[k] for k in key): r for r in df.collect()}


@pytest.fixture(scope="module")
def network(spark):
    """Three vertical components with six minutes of noise, of which one lacks a minute."""
    rng = np.random.default_rng(0)
    common = rng.standard_normal(int(7 * LENGTH * RATE))
    data = {c: common[5 * c : 5 * c + int(6 * LENGTH * RATE)] + 0.3 * rng.standard_normal(int(6 * LENGTH * RATE)) for c in (1, 2, 3)}
    parts = []
    for c, x in data.items():
        for s in range(0, len(x), 100):
            if not (c == 3 and 2 * LENGTH * RATE - 50 <= s < 3 * LENGTH * RATE):
                parts.append((c, DAY + dt.timedelta(seconds=s / RATE), RATE, x[s : s + 100].tolist()))
    records = spark.createDataFrame(parts, "component_id long, starttime timestamp_ntz, rate double, samples array<double>").repartition(4).cache()
    spans = spark.createDataFrame([(k, DAY + dt.timedelta(seconds=k * LENGTH), DAY + dt.timedelta(seconds=(k + 1) * LENGTH)) for k in range(6)], "timespan_id long, starttime timestamp_ntz, endtime timestamp_ntz")
    return data, records, spans


@pytest.fixture(scope="module")
def chunks(spark, network):
    _, records, spans = network
    none = empty(spark, f"{KEY}, samples array<double>, deficit long")
    params = config.DatachunkParams(datachunk_sample_tolerance=0.15)
    first = jobs.datachunks(records, spans.filter("timespan_id < 4"), none, params, RATE).cache()
    both = jobs.datachunks(records, spans, first, params, RATE).cache()
    assert first.count() == 11 and both.count() == 17 and jobs.datachunks(records, spans, both, params, RATE).count() == 17
    return both


def test_chunks_are_the_samples(network, chunks):
    data, _, _ = network
    n = int(LENGTH * RATE)
    held = rows(chunks, "component_id", "timespan_id")
    assert (3, 2) not in held
    for (c, k), r in held.items():
        if (c, k) not in ((3, 1), (3, 3)):
            assert r.samples == pytest.approx(data[c][k * n : (k + 1) * n]) and r.deficit == 0


def test_statistics_and_verdicts(spark, network, chunks):
    _, _, spans = network
    names = "energy double, min double, max double, mean double, variance double, skewness double, kurtosis double"
    stats = jobs.statistics(chunks, jobs.statistics(chunks.filter("component_id = 1"), empty(spark, f"{KEY}, {names}")))
    held, samples = rows(stats, "component_id", "timespan_id"), rows(chunks, "component_id", "timespan_id")
    assert set(held) == set(samples)
    for k, r in held.items():
        x = np.array(samples[k].samples)
        assert (r.energy, r["min"], r["max"], r.mean, r.variance) == pytest.approx((np.mean(x * x), x.min(), x.max(), x.mean(), x.var(ddof=1)))
    limit = float(np.median([r.energy for r in held.values()]))
    params = config.QCOneConfig(starttime="2020-03-01T00:01:00", endtime="2020-03-02", signal_energy_max=limit, avg_gps_time_error_max=1.0, null_treatment_policy="pass")
    gps = spark.createDataFrame([(2, 2, 5.0, 0.0)], f"{KEY}, error double, uncertainty double")
    periods = spark.createDataFrame([(1, DAY + dt.timedelta(seconds=200), DAY + dt.timedelta(seconds=210))], "component_id long, starttime timestamp_ntz, endtime timestamp_ntz")
    columns = ", ".join(f"{c} boolean" for c in ("ok_starttime", "ok_endtime", "ok_accepted_time", "ok_energy_max", "ok_error_max", "is_passing"))
    verdicts = jobs.qc_one(stats, spans, gps, periods, empty(spark, f"{KEY}, {columns}"), params)
    for (c, k), r in rows(verdicts, "component_id", "timespan_id").items():
        ok = k >= 1 and held[c, k].energy <= limit and (c, k) != (2, 2) and (c, k) != (1, 3)
        assert r.is_passing is ok, (c, k)


def test_correlations_and_stacks(spark, network, chunks):
    _, _, spans = network
    done = jobs.processed(chunks, empty(spark, f"{KEY}, samples array<double>"), config.ProcessedDatachunkParams(filtering_low=0.5, filtering_high=3.0), RATE).cache()
    assert done.count() == 17 and all(set(r.samples) <= {-1.0, 0.0, 1.0} for r in done.collect())
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (2, 2)], "component_id_a long, component_id_b long")
    none = empty(spark, "component_id_a long, component_id_b long, timespan_id long, ccf array<double>")
    ccfs = jobs.crosscorrelations(done, pairs, jobs.crosscorrelations(done, pairs.filter("component_id_a = 1"), none, 16), 16).cache()
    held, samples = rows(ccfs, "component_id_a", "component_id_b", "timespan_id"), rows(done, "component_id", "timespan_id")
    assert len(held) == 6 + 5 + 5 + 6
    for (a, b, k), r in held.items():
        assert r.ccf == pytest.approx(dsp.correlate(np.array(samples[a, k].samples), np.array(samples[b, k].samples), 16))
    assert np.argmax(held[1, 2, 0].ccf) == 16 + 5 and np.argmax(held[2, 2, 0].ccf) == 16  # the second lags by five samples
    stack_spans = spark.createDataFrame([(s, DAY + dt.timedelta(seconds=s * LENGTH), DAY + dt.timedelta(seconds=(s + 3) * LENGTH)) for s in (0, 3)], "stack_id long, stack_start timestamp_ntz, stack_end timestamp_ntz")
    good = ccfs.select("component_id_a", "component_id_b", "timespan_id", (F.col("timespan_id") != 4).alias("is_passing"))
    none = empty(spark, "component_id_a long, component_id_b long, stack_id long, stack array<double>, no_ccfs long")
    stacks = rows(jobs.stacks(ccfs, spans, stack_spans, none, 3, good), "component_id_a", "component_id_b", "stack_id")
    assert set(stacks) == {(1, 2, 0), (2, 2, 0)}
    assert stacks[1, 2, 0].stack == pytest.approx(np.mean([held[1, 2, k].ccf for k in range(3)], axis=0))


def test_rotated_correlations(spark):
    """Parts in either order of their components; a code that lacks one has no row."""
    rng = np.random.default_rng(3)
    ids = {("a", "E"): 1, ("a", "N"): 2, ("a", "Z"): 3, ("b", "E"): 4, ("b", "N"): 5, ("b", "Z"): 6}
    pairs = spark.createDataFrame([("A", "B", 40.0, code, *(ids[s, x] for s in "ab" for x in "ENZ")) for code in ("RR", "TT", "RT", "TR", "RZ", "TZ", "ZR", "ZT")], "station_a string, station_b string, backazimuth double, component_cylindrical_code_pair string, aE long, aN long, aZ long, bE long, bN long, bZ long")
    ccf = {(x, y): rng.standard_normal(9) for x in "ENZ" for y in "ENZ"}
    rows = [((ids["a", x], ids["b", y], 0, v.tolist()) if x != "N" else (ids["b", y], ids["a", x], 0, v[::-1].tolist())) for (x, y), v in ccf.items() if (x, y) != ("Z", "N")]
    held = spark.createDataFrame(rows, "component_id_a long, component_id_b long, timespan_id long, ccf array<double>")
    none = empty(spark, "station_a string, station_b string, code string, timespan_id long, ccf array<double>")
    once = jobs.cylindrical(held, pairs, none)
    got = {r.code: np.array(r.ccf) for r in jobs.cylindrical(held, pairs, once).collect()}
    s, c = np.sin(np.radians(40.0)), np.cos(np.radians(40.0))
    ee, en, ne, nn = (ccf[p] for p in (("E", "E"), ("E", "N"), ("N", "E"), ("N", "N")))
    expected = {
        "RR": s * s * ee + s * c * en + s * c * ne + c * c * nn, "TT": c * c * ee - s * c * en - s * c * ne + s * s * nn,
        "RT": -s * c * ee + s * s * en - c * c * ne + s * c * nn, "TR": -s * c * ee - c * c * en + s * s * ne + s * c * nn,
        "RZ": -s * ccf["E", "Z"] - c * ccf["N", "Z"], "TZ": -c * ccf["E", "Z"] + s * ccf["N", "Z"],
    }
    assert set(got) == set(expected) and all(got[k] == pytest.approx(v) for k, v in expected.items())


def test_spectra_events_and_grids(spark, network, chunks):
    params = config.PPSDParams(segment_length=10.0, segment_step=5.0, freq_min=0.5, freq_max=3.0, sampling_rate=RATE)
    spectra = jobs.power_spectra(chunks, empty(spark, f"{KEY}, mean array<double>, std array<double>, segments long"), params)
    assert {r.segments for r in spectra.collect()} == {11} and spectra.count() == 17
    events = config.EventDetectionParams(detection_type="amplitude_spike", peak_ground_velocity_threshold=3.0, output_margin_length_sec=0.5, trace_trimming_sec=1.0)
    found, searched = jobs.events(chunks, empty(spark, KEY), events, RATE)
    again, _ = jobs.events(chunks, searched, events, RATE)
    assert again.count() == 0 and searched.count() == 17
    samples = rows(chunks, "component_id", "timespan_id")
    for r in found.collect():
        x = np.array(samples[r.component_id, r.timespan_id].samples)
        assert r.pgv == pytest.approx(np.abs(x[r["first"] : r["last"] + 1]).max()) and r.pgv >= 3.0 and r["first"] >= 8 and r["last"] < len(x) - 8
    covered = {(r.component_id, r.timespan_id, i) for r in found.collect() for i in range(r["first"], r["last"] + 1)}
    assert {(c, k, i) for (c, k), r in samples.items() for i, v in enumerate(r.samples[8:-8], 8) if abs(v) >= 3.0} <= covered
    table = empty(spark, "timespan_id long, starttime timestamp_ntz, midtime timestamp_ntz, endtime timestamp_ntz")
    day = jobs.timespans(table, "2020-03-01", "2020-03-02", 21600)
    two = sorted(tuple(r) for r in jobs.timespans(day, "2020-03-01", "2020-03-03", 21600).select("timespan_id", "starttime").collect())
    assert two == [(k + 1, DAY + dt.timedelta(hours=6 * k)) for k in range(8)]


def test_gps_means(spark, network):
    _, _, spans = network
    at = lambda s: DAY + dt.timedelta(seconds=s)
    samples = spark.createDataFrame([("A", at(0), 1.0, 4.0), ("A", at(60), 3.0, 6.0), ("B", at(10), 7.0, None)], "station string, datetime timestamp_ntz, time_error double, time_uncertainty double")
    components = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "component_id long, station string")
    old = spark.createDataFrame([(1, 0, 99.0, 99.0), (9, 9, 1.0, 1.0)], f"{KEY}, error double, uncertainty double")
    got = sorted(tuple(r) for r in jobs.soh(samples, components, spans, old).collect())
    assert got == [(1, 0, 2.0, 5.0), (1, 1, 3.0, 6.0), (2, 0, 2.0, 5.0), (2, 1, 3.0, 6.0), (3, 0, 7.0, None), (9, 9, 1.0, 1.0)]


def wave(places, slowness, n=480, seed=1):
    """One plane wave of noise at stations, delayed in the spectrum."""
    spectrum = np.fft.rfft(np.random.default_rng(seed).standard_normal(n))
    f = np.fft.rfftfreq(n, 1 / RATE)
    return np.fft.irfft(spectrum[None] * np.exp(-2j * np.pi * f[None] * (places @ slowness)[:, None]), n)


@pytest.mark.parametrize("method", ["beamforming", "capon"])
def test_beams_find_a_plane_wave(spark, method):
    places = np.random.default_rng(2).uniform(-3, 3, (7, 2))
    x = wave(places, np.array([0.2, -0.1]))
    df = spark.createDataFrame([(k, i, x[i].tolist(), *map(float, places[i])) for k in (1, 2) for i in range(7 if k == 1 else 2)], "timespan_id long, vec_id long, x array<double>, px double, py double")
    params = config.BeamformingParams(min_freq=0.5, max_freq=2.0, slowness_step=0.1, window_length=20.0, window_step_fraction=0.5, method=method, extract_peaks_all_beamformers_abspower=True, extract_peaks_average_beamformer_relpower=True, extract_peaks_all_beamformers_relpower=True, beam_portion_threshold=0.2)
    found = signals.beam_peaks(df, params, RATE).collect()
    assert {r.timespan_id for r in found} == {1} and {r.kind for r in found} == {"average_abspower", "all_abspower", "average_relpower", "all_relpower"}
    for r in found:
        if r.rank == 1:
            assert (r.sx, r.sy) == pytest.approx((0.2, -0.1)) and r.slowness == pytest.approx(np.hypot(0.2, 0.1)) and r.backazimuth == pytest.approx(np.degrees(np.arctan2(0.2, -0.1)) % -360 + 180)
            assert r.occurrences == (5 if r.kind.startswith("all") else 1)
            if r.kind == "average_relpower" and method == "beamforming":
                assert 0.9 < r.amplitude <= 1.0 + 1e-9


def test_nodes_around_a_peak():
    grid = np.zeros((9, 9))
    grid[2, 3], grid[6, 6], grid[6, 7] = 2.0, 1.0, 1.0
    assert dsp.peaks(grid, 3) == [(2, 3), (6, 6)] and dsp.peaks(grid, 3, count=1) == [(2, 3)]
    assert dsp.peaks(grid, 3, threshold=1.5) == [(2, 3)] and dsp.peaks(np.ones((4, 4)), 3) == []
    delays = dsp.source_delays(np.array([[0.0, 0.0], [3.0, 4.0]]), np.array([0.0, 3.0]), np.array([0.0, 4.0]), 2.0)
    assert delays.tolist() == [[0.0, 8.0, 6.0, 10.0], [10.0, 6.0, 8.0, 0.0]]
    assert dsp.significant([[(1, 1, 3.0), (2, 2, 1.0)], [(1, 1, 1.0)]], 0.9) == [(1, 1, 1.0, 1, 1.0)]
    assert dsp.significant([[(1, 1, 2.0), (2, 2, 2.0)]], 0.9) == [(1, 1, 2.0, 1, 0.5), (2, 2, 2.0, 1, 0.5)] and dsp.significant([[]], 0.1) == []
