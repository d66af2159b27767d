"""Queries that SQL can't express, against plain numpy of their own, trace by trace."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillwave import config
from stillwave.functions import dsp
from stillwave.operators import signals, stacking
from stillwave.plans import catalogue

RATE = 64.0


@pytest.fixture(scope="module")
def waves(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    return {r.vec_id: (r.label, np.array(r.embedding, float)) for r in rows}


def results(spark, sf, name):
    return {r.vec_id: np.array(r.y) for r in catalogue.QUERIES[name](spark, sf).collect()}


def cubic_rest(x):
    t = np.arange(len(x), dtype=float)
    return x - np.polyval(np.polyfit(t, x, 3), t)


def difference_equation(x, low, high, rate, order):
    """The band-pass as one direct recursion of its whole polynomial, from its poles in turn."""
    b, a = np.array([1.0]), np.array([1.0])
    for s in dsp.butterworth(low, high, rate, order):
        b, a = np.convolve(b, s[:3]), np.convolve(a, s[3:])
    y = np.zeros(len(x))
    for i in range(len(x)):
        y[i] = sum(b[k] * x[i - k] for k in range(len(b)) if i >= k) - sum(a[k] * y[i - k] for k in range(1, len(a)) if i >= k)
    return y


def flattened(x, water):
    s = np.fft.fft(x)
    return np.fft.ifft(s / np.maximum(np.abs(s), water * np.abs(s).max())).real


def halved_rates(x, n):
    """Fourier resampling by a sum of cosines at the new places."""
    c = np.fft.fft(x)
    t = np.arange(n) * len(x) / n
    out = np.full(n, c[0].real)
    for k in range(1, n // 2):
        out += 2 * (c[k] * np.exp(2j * np.pi * k * t / len(x))).real
    half = c[n // 2]
    return (out + (half * np.exp(2j * np.pi * (n // 2) * t / len(x))).real) / len(x)


def without_response(x):
    """Division in the spectrum of twice the length, frequency by frequency."""
    x = x - x.mean()
    edge = np.minimum(np.arange(64), np.arange(64)[::-1])
    x = np.concatenate([x * np.where(edge >= 3, 1.0, 0.5 * (1 - np.cos(np.pi * edge / 3))), np.zeros(64)])
    c = np.fft.fft(x)
    h = np.array([800.0 * (2j * np.pi * f) ** 2 / ((2j * np.pi * f + 4.44) ** 2 + 4.44**2) for f in np.arange(65) / 2.0])
    least = np.abs(h).max() / 1000
    half = [0.0 if k == 0 else c[k] / (h[k] / abs(h[k]) * max(abs(h[k]), least)) for k in range(65)]
    return np.fft.ifft(half + [np.conj(v) for v in half[63:0:-1]]).real[:64]


EXPECTED = {
    "dsp8_response_removed": without_response,
    "dsp4_detrend": cubic_rest,
    "dsp5_resample": lambda x: halved_rates(x, 16),
    "dsp7_bandpass": lambda x: difference_equation(x, 2.0, 16.0, RATE, 4),
    "dsp10_whiten": lambda x: flattened(x, 0.01),
    "dsp12_process": lambda x: np.sign(difference_equation(flattened(x, 0.01), 2.0, 16.0, RATE, 4)),
    "dsp15_power_spectrum": lambda x: np.abs(np.fft.fft(x)[:33]) ** 2 * np.where(np.isin(np.arange(33), (0, 32)), 1, 2) / (RATE * 64),
}


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_trace_by_trace(spark, sf, waves, name):
    got = results(spark, sf, name)
    assert set(got) == set(waves)
    for i, (_, x) in waves.items():
        assert got[i] == pytest.approx(EXPECTED[name](x), abs=1e-7), i


def test_preprocess(spark, sf, waves):
    def whole(x):
        x = cubic_rest(x)
        x = halved_rates(x - x.mean(), 32)
        edge = np.minimum(np.arange(32), np.arange(32)[::-1])
        x = x * np.where(edge >= 1, 1.0, 0.0)
        for _ in range(2):
            x = difference_equation(x, 2.0, 12.0, 32.0, 4)
        return difference_equation(x[::-1], 2.0, 12.0, 32.0, 4)[::-1]

    got = results(spark, sf, "dsp9_preprocess")
    for i, (_, x) in list(waves.items())[:60]:
        assert got[i] == pytest.approx(whole(x), abs=1e-7)


def test_average_spectra(spark, sf, waves):
    got = {r.label: (np.array(r.stack), r.no_ccfs) for r in catalogue.QUERIES["ag5_average_psd"](spark, sf).collect()}
    for label in {k for k, _ in waves.values()}:
        own = [EXPECTED["dsp15_power_spectrum"](x) for k, x in waves.values() if k == label]
        assert got[label][1] == len(own) and got[label][0] == pytest.approx(np.mean(own, axis=0), abs=1e-9)  # nine digits


def power_map(xs, places, axis, band, method):
    """Beam power node by node and frequency by frequency."""
    freqs = np.arange(xs.shape[1] // 2 + 1) * RATE / xs.shape[1]
    out = np.zeros((len(axis), len(axis)))
    picked = [k for k, f in enumerate(freqs) if band[0] <= f <= band[1]]
    for k in picked:
        s = np.array([np.fft.fft(x)[k] for x in xs])
        r = np.outer(s, s.conj())
        inverse = np.linalg.pinv(r + 1e-3 * np.trace(r).real / len(s) * np.eye(len(s)), rcond=1e-6) if method == "capon" else None
        for i, sx in enumerate(axis):
            for j, sy in enumerate(axis):
                e = np.exp(-2j * np.pi * freqs[k] * (places[:, 0] * sx + places[:, 1] * sy)) / np.sqrt(len(s))
                out[i, j] += (e.conj() @ r @ e).real if inverse is None else 1 / (e.conj() @ inverse @ e).real
    return out / len(picked)


@pytest.mark.parametrize(("name", "method"), [("dsp16_beams", "bartlett"), ("dsp16_capon_beams", "capon")])
def test_beams(spark, sf, waves, name, method):
    rows = [r for r in catalogue.QUERIES[name](spark, sf).collect() if r.timespan_id < 3]
    axis = [(i - 8) * 0.05 for i in range(17)]
    for g in range(3):
        ids = sorted(i for i in waves if i // 16 == g)
        level = np.array([np.log(np.abs(np.fft.fft(waves[i][1])[2:13])).mean() for i in ids])
        kept = np.ones(len(ids), bool)
        while True:  # stations that stand out go, again and again
            now = kept & (np.abs(level - level[kept].mean()) <= 2 * level[kept].std() + 1e-12)
            if (now == kept).all() or kept.sum() <= 2:
                break
            kept = now
        ids = [i for i, k in zip(ids, kept, strict=True) if k]
        grid = power_map(np.array([waves[i][1] for i in ids]), np.array([[np.cos(i), np.sin(i * 1.7)] for i in ids]), axis, (2.0, 12.0), method)
        best = sorted((r.rank, r.sx, r.sy, r.power) for r in rows if r.timespan_id == g)
        tops = [(i, j) for i in range(17) for j in range(17) if all(grid[i, j] >= grid[a, b] for a in range(max(0, i - 1), min(17, i + 2)) for b in range(max(0, j - 1), min(17, j + 2)))]
        tops = sorted(tops, key=lambda p: -grid[p])[:3]
        assert [b[0] for b in best] == list(range(1, len(tops) + 1))
        for (_, sx, sy, power), (i, j) in zip(best, tops, strict=True):
            assert (sx, sy) == pytest.approx((axis[i], axis[j])) and power == pytest.approx(grid[i, j], rel=1e-6)


def test_detections(spark, sf, waves):
    expected = set()
    for i, (_, x) in waves.items():
        mean = lambda n, t, x=x: np.mean(x[t + 1 - n : t + 1] ** 2)
        on = None
        for t in range(65):
            ratio = mean(3, t) / mean(16, t) if 15 <= t < 64 else 0.0
            if on is None and t < 64 and ratio > 2.0:
                on = t
            elif on is not None and (t == 64 or ratio <= 1.0):
                expected.add((i, on, t - 1, round(float(np.abs(x[on:t]).max()), 9)))
                on = None
    got = {(r.vec_id, r.first, r.last, round(r.pgv, 9)) for r in catalogue.QUERIES["dsp22_detections"](spark, sf).collect()}
    assert got == expected and got


def test_blocks_of_samples_are_the_recursion():
    x = np.random.default_rng(0).standard_normal((3, 1000))
    for low, high in ((0.01, 11.0), (None, 4.0), (2.0, None)):
        sos = dsp.butterworth(low, high, 24.0, 4)
        slow, _ = dsp._walk(sos, x, np.zeros((3, len(sos), 2)))
        assert dsp.run_sections(sos, x) == pytest.approx(slow, abs=1e-7)  # poles near 1 magnify rounding in either form
    assert dsp.run_sections(sos, x[:, :0]).shape == (3, 0)


def test_correlations_lag_by_lag(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.standard_normal(n).tolist(), rng.standard_normal(m).tolist()) for k, (n, m) in enumerate([(50, 50), (50, 50), (7, 7), (9, 8), (1, 1)])] + [(9, None, [1.0]), (10, [], [])]
    df = spark.createDataFrame(rows, "k int, a array<double>, b array<double>")
    got = {r.k: r.y for r in signals.correlations(df, ["k"], "a", "b", 5, normalise=False, demean=False).collect()}
    for k, a, b in rows:
        if not a or len(a) != len(b):
            assert got[k] is None
        else:
            assert got[k] == pytest.approx([sum(a[i + lag] * b[i] for i in range(len(b)) if 0 <= i + lag < len(a)) for lag in range(-5, 6)], abs=1e-9)
    same = {r.k: r.y for r in signals.correlations(df.select("k", "a", F.col("a").alias("b")), ["k"], "a", "b", 5).collect()}
    assert same[0][5] == pytest.approx(1.0) and max(same[0]) == same[0][5]


def test_segment_spectra(spark):
    p = config.PPSDParams(segment_length=2.0, segment_step=1.0, freq_min=1.0, freq_max=6.0, rejected_windows_quantile=0.2, sampling_rate=24.0)
    x = np.random.default_rng(2).standard_normal(24 * 9)
    got = {r.vec_id: r for r in signals.spectra(spark.createDataFrame([(1, x.tolist()), (2, [1.0]), (3, None)], "vec_id int, x array<double>"), p).collect()}
    parts = [np.abs(np.fft.fft(x[s : s + 48]))[2:13] ** 2 * 2 / 24.0**2 / 2.0 for s in range(0, len(x) - 47, 24)]
    energy = [q.sum() for q in parts]
    kept = [q for q, e in zip(parts, energy, strict=True) if np.quantile(energy, 0.2) < e < np.quantile(energy, 0.8)]
    assert got[1].segments == 8 and got[1].mean == pytest.approx(np.mean(kept, axis=0)) and got[1]["std"] == pytest.approx(np.std(kept, axis=0))
    assert got[2].mean is None and got[3].mean is None and len(p.frequencies) == 11
    resampled = config.PPSDParams(segment_length=2.0, segment_step=1.0, freq_min=1.0, freq_max=6.0, resample=True, resampled_frequency_start=2.0, resampled_frequency_stop=4.0, resampled_frequency_step=0.25, rejected_windows_quantile=0.0, sampling_rate=24.0)
    assert len(signals.spectra(spark.createDataFrame([(1, x.tolist())], "vec_id int, x array<double>"), resampled).first().mean) == 8


def test_stack_in_parts(spark, monkeypatch):
    """Sums of many tasks and small memories are the mean of all; arrays may differ in length."""
    monkeypatch.setattr(stacking, "HELD", 2)
    rows = [(i % 5, None if i == 7 else [float(i), i * 2.0] + [1.0] * (i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, y array<double>").repartition(6)
    got = {r.k: (r.stack, r.no_ccfs) for r in stacking.linear_stack(df, ["k"], "y", least=12).collect()}
    assert set(got) == {0, 1, 3, 4}
    for k, (stack, n) in got.items():
        own = [y for j, y in rows if j == k]
        assert n == 12 and stack == pytest.approx([np.mean([y[0] for y in own]), np.mean([y[1] for y in own]), 1.0])
