import numpy as np
import pytest

from stillwave.functions import dsp

rng = np.random.default_rng(0)


def amplitude(x):
    return np.sqrt(2 * (x * x).mean())


def test_bandpass_gain_and_stop():
    rate, t = 100.0, np.arange(4000) / 100.0
    tone = lambda f: amplitude(dsp.bandpass(np.sin(2 * np.pi * f * t), 5, 15, rate)[2000:])
    assert tone(8.7) == pytest.approx(1.0, abs=0.02)
    assert tone(5.0) == pytest.approx(np.sqrt(0.5), abs=0.02) and tone(15.0) == pytest.approx(np.sqrt(0.5), abs=0.02)
    assert tone(1.0) < 1e-2 and tone(40.0) < 1e-2


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
def test_low_and_high_pass(order):
    rate, t = 100.0, np.arange(3000) / 100.0
    assert np.abs(dsp.bandpass(np.ones(3000), None, 10, rate, order)[-1]) == pytest.approx(1.0, abs=1e-6)
    assert np.abs(dsp.bandpass(np.ones(3000), 10, None, rate, order)[-1]) < 1e-6
    assert amplitude(dsp.bandpass(np.sin(2 * np.pi * 10 * t), None, 10, rate, order)[1500:]) == pytest.approx(np.sqrt(0.5), abs=0.02)


def test_spectrum_keeps_energy():
    x = rng.standard_normal(400)
    assert dsp.power_spectrum(x, 20.0).sum() * 20.0 / 400 == pytest.approx((x * x).mean())


def test_autocorrelation_peaks_at_zero():
    x = rng.standard_normal(300)
    y = dsp.correlate(x, x, 20)
    assert np.argmax(y) == 20 and y[20] == pytest.approx(1.0)
    shifted = dsp.correlate(np.roll(x, 7), x, 20, normalise=False)
    assert np.argmax(shifted) == 27


def test_whiten_flattens():
    x = np.cumsum(rng.standard_normal(512))
    assert np.abs(np.fft.rfft(dsp.whiten(x, 1e-9))) == pytest.approx(np.ones(257), abs=1e-6)
    assert not dsp.whiten(np.zeros(8)).any()


def test_resample_keeps_a_slow_tone():
    t = np.arange(256) / 64
    y = dsp.resample(np.cos(2 * np.pi * 2 * t), 64, 16)
    assert y == pytest.approx(np.cos(2 * np.pi * 2 * np.arange(64) / 16), abs=1e-9)
    assert len(dsp.resample(rng.standard_normal(6400), 640, 10)) == 100


def test_detrend_and_taper():
    t = np.linspace(0, 1, 100)
    assert dsp.detrend(3 * t**3 - t + 5) == pytest.approx(np.zeros(100), abs=1e-9)
    y = dsp.taper(np.ones(100), 0.1)
    assert y[0] == y[-1] == 0 and (y[10:90] == 1).all()


def test_sta_lta_and_triggers():
    x = np.concatenate([np.ones(100), 10 * np.ones(10), np.ones(100)])
    ratio = dsp.classic_sta_lta(x, 5, 50)
    assert not ratio[:49].any() and ratio[60] == pytest.approx(1.0)
    assert dsp.triggers(ratio, 3.0, 1.0)[0][0] in range(100, 104)
    assert dsp.triggers(np.array([0, 5, 5.0]), 3, 1) == [(1, 2)]


def test_nnls_recovers_non_negative_weights():
    a, x = rng.random((30, 6)), np.array([0, 2.0, 0, 1.0, 0.5, 0])
    assert dsp.nnls(a, a @ x) == pytest.approx(x, abs=1e-8)
    assert (dsp.nnls(a, -a.sum(1)) == 0).all()


@pytest.mark.parametrize("method", ["bartlett", "capon"])
def test_beam_points_at_the_wave(method):
    places = rng.uniform(-2, 2, (8, 2))
    axis, freqs = np.linspace(-0.4, 0.4, 17), np.linspace(0.5, 1.5, 11)
    wave = np.exp(-2j * np.pi * freqs[None] * (places @ np.array([0.2, -0.1]))[:, None])
    power = dsp.beam_power(wave, freqs, places, axis, method)
    i, j = dsp.local_maxima(power, 1)[0]
    assert axis[i] == pytest.approx(0.2) and axis[j] == pytest.approx(-0.1)


def test_local_maxima_of_a_plateau():
    g = np.zeros((7, 7))
    g[1:4, 1:4] = 2
    g[5, 5] = 3
    assert dsp.local_maxima(g, 5) == [(5, 5), (2, 2)]


def test_reject_and_deconvolve():
    s = np.ones((6, 20)) * np.array([1, 1.1, 0.9, 1, 1.05, 1e6])[:, None]
    assert dsp.statistical_reject(s).tolist() == [True] * 5 + [False]
    r = np.stack([np.exp(-((np.arange(50) - c) ** 2) / 8) for c in range(50)], 1)
    chosen, weights, rest = dsp.deconvolve(2 * r[:, 10] + r[:, 35], r, 2)
    assert sorted(chosen) == [10, 35] and rest < 1e-6 and sorted(weights.round(6)) == [1, 2]
