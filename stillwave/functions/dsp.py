"""Signal kernels in numpy; they know nothing of Spark.

Where the usual libraries leave choices open, the definition here is stated in the
docstring. Filters are cascades of second-order sections from the bilinear transform of the
analogue Butterworth prototype.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def mean(x: np.ndarray) -> np.ndarray:
    return x.mean(-1, keepdims=True)


def detrend(x: np.ndarray, order: int = 3) -> np.ndarray:
    """Less the least-squares polynomial, fitted over -1 to 1 for stability."""
    n = x.shape[-1]
    if n <= order:
        return x - x.mean(-1, keepdims=True) if n else x
    t = np.linspace(-1, 1, n)
    basis, _ = np.linalg.qr(np.vander(t, order + 1))
    return x - (x @ basis) @ basis.T


def taper(x: np.ndarray, share: float = 0.05) -> np.ndarray:
    n = x.shape[-1]
    width = max(1, int(n * share))
    edge = np.minimum(np.arange(n), np.arange(n)[::-1])
    return x * np.where(edge >= width, 1.0, 0.5 * (1 - np.cos(np.pi * edge / width)))


def butterworth(low: float | None, high: float | None, rate: float, order: int = 4) -> np.ndarray:
    """Sections (b0 b1 b2 1 a1 a2) of a band-pass, or of a low- or high-pass where one
    corner is None."""
    nyquist = rate / 2
    for corner in (low, high):
        if corner is not None and not 0 < corner < nyquist:
            raise ValueError(f"corner {corner} outside 0 to {nyquist}")
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    warp = lambda f: 2 * rate * np.tan(np.pi * f / rate)
    if low is not None and high is not None:
        width, centre = warp(high) - warp(low), np.sqrt(warp(high) * warp(low))
        half = poles * width / 2
        root = np.sqrt(half**2 - centre**2)
        analogue, zeros_at_one, middle = np.concatenate([half + root, half - root]), order, centre
    elif high is not None:
        analogue, zeros_at_one, middle = poles * warp(high), 0, 0.0
    elif low is not None:
        analogue, zeros_at_one, middle = warp(low) / poles, order, np.inf
    else:
        raise ValueError("give a corner")
    digital = (2 * rate + analogue) / (2 * rate - analogue)
    zeros = np.array([1.0] * zeros_at_one + [-1.0] * (len(digital) - zeros_at_one))
    digital = digital[np.argsort(digital.imag)]
    # Conjugates pair up; the real poles of an odd order pair among themselves.
    complex_ones = digital[digital.imag > 1e-12]
    real_ones = np.sort(digital[np.abs(digital.imag) <= 1e-12].real)
    denominators = [np.array([1.0, -2 * p.real, abs(p) ** 2]) for p in complex_ones]
    for i in range(0, len(real_ones), 2):
        pair = real_ones[i : i + 2]
        denominators.append(np.array([1.0, -pair.sum(), pair.prod() if len(pair) == 2 else 0.0]))
    if low is not None and high is not None:
        # One zero at 1 and one at -1 for each section keeps every section's gain bounded.
        zeros = np.array([1.0, -1.0] * order)
    sections = []
    for k, a in enumerate(denominators):
        z = zeros[2 * k : 2 * k + 2]
        b = np.array([1.0, -z.sum(), z.prod() if len(z) == 2 else 0.0])
        sections.append(np.concatenate([b, a]))
    sos = np.array(sections)
    at = np.exp(2j * np.arctan(middle / (2 * rate))) if np.isfinite(middle) else -1.0
    gain = np.prod([np.polyval(s[:3], at) / np.polyval(s[3:], at) for s in sos])
    sos[0, :3] /= abs(gain)
    return sos


#: Samples that a filter takes in one step.
BLOCK = 128


def _walk(sos: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cascade over the last axis sample by sample, from a state (..., section, 2); the
    output, and the states after each sample."""
    out, states = np.empty_like(x), np.empty((x.shape[-1], *state.shape))
    for i in range(x.shape[-1]):
        v = x[..., i]
        state = state.copy()
        for k, (b0, b1, b2, _, a1, a2) in enumerate(sos):
            w = b0 * v + state[..., k, 0]
            state[..., k, 0] = b1 * v - a1 * w + state[..., k, 1]
            state[..., k, 1] = b2 * v - a2 * w
            v = w
        out[..., i], states[i] = v, state
    return out, states


def run_sections(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The cascade over the last axis, from rest; traces run side by side.

    What a block of samples gives out, and the state that it leaves, are linear in the block
    and in the state before it. The matrices follow from one impulse and the unit states, so
    blocks are products of matrices, and only their states are passed on one by one.
    """
    x = np.asarray(x, float)
    n, size = x.shape[-1], 2 * len(sos)
    if n == 0:
        return x
    first, state = np.zeros((size + 1, BLOCK)), np.zeros((size + 1, len(sos), 2))
    first[0, 0] = 1.0
    state[1:] = np.eye(size).reshape(size, len(sos), 2)
    given, left = _walk(sos, first, state)
    left = left.reshape(BLOCK, size + 1, size)
    lag = np.arange(BLOCK)[:, None] - np.arange(BLOCK)[None]
    of_block = np.where(lag >= 0, given[0][np.maximum(lag, 0)], 0.0).T
    reach, over, of_state = left[::-1, 0], left[-1, 1:], given[1:]
    blocks = -(-n // BLOCK)
    padded = np.zeros((*x.shape[:-1], blocks * BLOCK))
    padded[..., :n] = x
    padded = padded.reshape(*x.shape[:-1], blocks, BLOCK)
    added = padded @ reach
    before = np.zeros((*x.shape[:-1], blocks, size))
    for b in range(1, blocks):
        before[..., b, :] = before[..., b - 1, :] @ over + added[..., b - 1, :]
    return (padded @ of_block + before @ of_state).reshape(*x.shape[:-1], -1)[..., :n]


def bandpass(x: np.ndarray, low: float | None, high: float | None, rate: float, order: int = 4, zero_phase: bool = False) -> np.ndarray:
    sos = butterworth(low, high, rate, order)
    y = run_sections(sos, x)
    return run_sections(sos, y[..., ::-1])[..., ::-1] if zero_phase else y


def resample(x: np.ndarray, rate: float, new_rate: float) -> np.ndarray:
    """Fourier resampling to round(n * new_rate / rate) samples; while the factor exceeds
    16 the trace is first halved, behind a zero-phase low-pass at 0.4 of the new rate."""
    while rate / new_rate > 16:
        x = bandpass(x, None, 0.4 * rate / 2, rate, 8, zero_phase=True)[..., ::2]
        rate /= 2
    n = x.shape[-1]
    m = int(round(n * new_rate / rate))
    if m == n or n == 0:
        return x
    spectrum = np.fft.rfft(x)
    keep = min(n, m) // 2 + 1
    out = np.zeros((*x.shape[:-1], m // 2 + 1), complex)
    out[..., :keep] = spectrum[..., :keep]
    if min(n, m) % 2 == 0 and m < n:
        out[..., keep - 1] = out[..., keep - 1].real * 2 if m % 2 == 0 else out[..., keep - 1]
        out[..., keep - 1] *= 0.5 if m % 2 == 0 else 1.0
    return np.fft.irfft(out, m) * (m / n)


def whiten(x: np.ndarray, water: float = 0.01, quefrency: float | None = None, rate: float = 1.0) -> np.ndarray:
    """The spectrum over its magnitude, raised to at least ``water`` of the largest; with a
    ``quefrency`` (seconds) the magnitude is smoothed by cutting its cepstrum there."""
    spectrum = np.fft.rfft(x)
    size = np.abs(spectrum)
    if quefrency is not None:
        cepstrum = np.fft.irfft(np.log(np.maximum(size, 1e-300)))
        cut = max(1, int(quefrency * rate))
        cepstrum[..., cut : cepstrum.shape[-1] - cut + 1] = 0
        size = np.exp(np.fft.rfft(cepstrum).real)[..., : spectrum.shape[-1]]
    most = size.max(-1, keepdims=True, initial=0)
    quiet = np.abs(spectrum).max(-1, keepdims=True, initial=0) == 0
    return np.where(quiet, 0.0, np.fft.irfft(spectrum / np.maximum(size, np.maximum(water * most, 1e-300)), x.shape[-1]))


def taper_ends(n: int, width: int, kind: str = "hann", side: str = "both") -> np.ndarray:
    """Ones with so many places at the ends (or at the ``left`` or ``right`` one) rising: as half of
    a symmetric Hann window of twice the width, or, as ``cosine``, as half a cosine from 0 to 1."""
    if kind not in ("hann", "cosine") or side not in ("both", "left", "right"):
        raise ValueError(f"no taper {kind} {side}")
    out = np.ones(n)
    if width > 0:
        edge = 0.5 - 0.5 * np.cos(np.pi * np.arange(width) / (width - 0.5 if kind == "hann" else max(1, width - 1)))
        if side != "right":
            out[:width] *= edge
        if side != "left":
            out[n - width :] *= edge[::-1]
    return out


def ramp(k: np.ndarray, first: int, width: int) -> np.ndarray:
    """Squared sine that rises from 0 at ``first`` to 1 at ``first + width - 1`` and stays there."""
    return np.sin(np.clip((k - first) / max(1, width - 1), 0, 1) * np.pi / 2) ** 2


def smoothing_width(n: int, rate: float, low: float, high: float, min_samples: int, ratio_to_bandwidth: float, max_ratio_to_low: float) -> int:
    """Places of the kernel that smooths a spectrum of n: a share of the band's width in Hz, no
    more than a share of its lower corner, and so many places at least."""
    hertz = min(ratio_to_bandwidth * (high - low), max_ratio_to_low * low)
    return min(max(1, n - 1), round(max(min_samples, hertz / (rate / 2) * n)))


def smoothed_log(log: np.ndarray, width: int, lowpass: float, taper_samples: int, taper_ratio: float) -> np.ndarray:
    """A log spectrum (last axis in the transform's order, its least 0) smoothed twice: by a moving
    mean over all but no frequency, made even, with zeros beyond the ends; and by a low-pass
    of its quefrencies, which keeps ``lowpass`` of them and falls off over a taper."""
    n = log.shape[-1]
    sums = np.cumsum(np.concatenate([np.zeros((*log.shape[:-1], 1)), log[..., 1:]], -1), -1)
    centre = np.arange(n - 1) + (width - 1) // 2
    mean = (sums[..., np.minimum(centre + 1, n - 1)] - sums[..., np.clip(centre + 1 - width, 0, n - 1)]) / width
    even = np.concatenate([log[..., :1], 0.5 * (mean + mean[..., ::-1])], -1)
    quefrency = np.minimum(np.arange(n), n - np.arange(n))
    kept = round(n * lowpass / 2)
    fall = max(taper_samples, round(n * taper_ratio))
    return np.fft.ifft(np.fft.fft(even) * (1 - ramp(quefrency, kept, fall))).real


def whitened(x: np.ndarray, rate: float, low: float, high: float, water: float, smooth: dict | None = None) -> np.ndarray:
    """Traces whose spectrum is divided by its size, raised to ``water`` of the largest, except
    at no frequency. Ends are tapered over a period of the lower corner, half the trace at
    most. Without energy the result is zero.

    With ``smooth`` (options of :func:`smoothing_width` and :func:`smoothed_log`) the size is
    smoothed, and what lies outside the band is tapered off over the kernel's width.
    """
    n = x.shape[-1]
    if not n:
        return x
    spectrum = np.fft.fft(x * taper_ends(n, min(n // 2, int(rate / low))))
    size = np.abs(spectrum)
    level = np.maximum(size, water * size.max(-1, keepdims=True))
    level[..., 0] = size[..., 0]
    band = 1.0
    if smooth is not None:
        width = smoothing_width(n, rate, low, high, smooth["min_samples"], smooth["ratio_to_bandwidth"], smooth["max_ratio_to_low"])
        log = np.log(np.maximum(level, 1e-300))
        least = log.min(-1, keepdims=True)
        level = np.exp(smoothed_log(log - least, width, smooth["lowpass"], smooth["taper_samples"], smooth["taper_ratio"]) + least)
        axis, k = np.linspace(0, rate / 2, max(1, round(n / 2))), np.minimum(np.arange(n), n - np.arange(n))
        first, last = (int(np.argmin(np.abs(axis - f))) for f in (low, high))
        band = ramp(k, first - width + 1, width) * (1 - ramp(k, last, width))
    return np.where(size.max(-1, keepdims=True) == 0, 0.0, np.fft.ifft(spectrum / np.where(level == 0, 1.0, level) * band).real)


def response(freqs: np.ndarray, poles: list[complex], zeros: list[complex], gain: float) -> np.ndarray:
    """A sensor's response at frequencies in Hz, from poles and zeros in radians a second and
    the gain that multiplies their quotient."""
    s = 2j * np.pi * freqs
    return gain * np.prod([s - z for z in zeros], axis=0) / np.prod([s - p for p in poles], axis=0)


def remove_response(x: np.ndarray, rate: float, poles: list[complex], zeros: list[complex], gain: float, taper_share: float = 0.05, water_db: float = 60.0) -> np.ndarray:
    """:func:`divide_response` by poles, zeros and gain."""
    return divide_response(x, rate, lambda freqs: response(freqs, poles, zeros, gain), taper_share, water_db)


def divide_response(x: np.ndarray, rate: float, of: Callable[[np.ndarray], np.ndarray], taper_share: float = 0.05, water_db: float = 60.0) -> np.ndarray:
    """The motion that gave ``x`` through a response, which ``of`` gives at frequencies: demeaned,
    tapered, padded to twice the length, and divided in the spectrum, where the response's
    size is raised to ``water_db`` below its largest. Where it is zero, as at no frequency, so
    is the result."""
    x = x - x.mean(-1, keepdims=True)
    length = x.shape[-1]
    if int(length * taper_share):
        x = taper(x, taper_share)
    n = 1 << (2 * length - 1).bit_length()
    h = of(np.fft.rfftfreq(n, 1 / rate))
    size = np.abs(h)
    floor = size.max() * 10 ** (-water_db / 20)
    raised = np.where(size > 0, h / np.maximum(size, 1e-300) * np.maximum(size, floor), 1.0)
    return np.fft.irfft(np.where(size > 0, np.fft.rfft(x, n) / raised, 0.0), n)[..., :length]


def _polynomials(top: list[float], bottom: list[float], at: np.ndarray) -> np.ndarray:
    """A quotient of polynomials in 1 / at, lowest power first; an empty one is 1."""
    value = lambda c: np.polyval(c[::-1], 1 / at) if c else np.ones(len(at))
    return value(top) / value(bottom)


def stage_response(stage: dict, freqs: np.ndarray) -> np.ndarray:
    """One stage of an instrument at frequencies in Hz: its gain times what its ``kind`` says.

    ``poles_zeros``: factor * product(s - zero) / product(s - pole), with s = 2 pi i f, or i f
    if ``domain`` is HERTZ, or exp(2 pi i f / rate) if it is DIGITAL. ``coefficients`` and
    ``fir``: numerator over denominator in powers of 1 / exp(2 pi i f / rate), or of s if the
    domain is RADIANS or HERTZ. A FIR's ``symmetry`` ODD mirrors all coefficients but the
    last, EVEN mirrors all. ``correction`` seconds of delay have been taken off the times of
    samples, so they are taken off here. A stage of no kind is its gain.
    """
    domain, kind = stage.get("domain") or "DIGITAL", stage.get("kind")
    unit = {"RADIANS": 2j * np.pi * freqs, "HERTZ": 1j * freqs}
    h = np.ones(len(freqs), complex)
    if kind is not None and domain == "DIGITAL" and not stage.get("rate"):
        raise ValueError(f"stage {stage.get('number')} is digital and has no sample rate")
    at = unit[domain] if domain in unit else np.exp(2j * np.pi * freqs / (stage.get("rate") or 1.0))
    if kind == "poles_zeros":
        for z in stage.get("zeros") or []:
            h = h * (at - complex(*z))
        for p in stage.get("poles") or []:
            h = h / (at - complex(*p))
        h = h * (1.0 if stage.get("factor") is None else stage["factor"])
    elif kind in ("coefficients", "fir"):
        top, bottom = list(stage.get("numerator") or []), list(stage.get("denominator") or [])
        if kind == "fir":
            top += {"ODD": top[-2::-1], "EVEN": top[::-1]}.get(stage.get("symmetry") or "NONE", [])
        h = _polynomials(top, bottom, at) if domain == "DIGITAL" else _polynomials(top, bottom, 1 / np.where(at == 0, 1e-300, at))
    h = h * np.exp(2j * np.pi * freqs * (stage.get("correction") or 0.0))
    return h * (1.0 if stage.get("gain") is None else stage["gain"])


#: By unit of the motion, how often it is to be differentiated to be a velocity.
DERIVATIVES = {"M": 1, "M/S": 0, "M/S**2": -1}


def stages_response(stages: list[dict], freqs: np.ndarray, unit: str = "M/S") -> np.ndarray:
    """All stages of an instrument in a row, for a velocity of the ground: what an instrument for
    displacement or acceleration (``unit``) gives for the velocity that goes with these."""
    h = np.prod([stage_response(s, freqs) for s in stages], axis=0) if stages else np.ones(len(freqs), complex)
    order = DERIVATIVES.get((unit or "M/S").upper().replace("M/S/S", "M/S**2"), 0)
    s = 2j * np.pi * freqs
    if order == 1:
        return np.where(s != 0, h / np.where(s != 0, s, 1), 0)
    return h * s if order == -1 else h


def power_spectrum(x: np.ndarray, rate: float) -> np.ndarray:
    """One-sided density 2 dt / n |X|^2; its sum times the step is the mean square."""
    n = x.shape[-1]
    p = 2.0 / (rate * n) * np.abs(np.fft.rfft(x)) ** 2
    p[..., 0] /= 2
    if n % 2 == 0:
        p[..., -1] /= 2
    return p


def segment_spectra(x: np.ndarray, rate: float, length: int, step: int, low: float, high: float, at: np.ndarray | None = None, tapered: float | None = None) -> np.ndarray:
    """Densities 2 dt^2 / T |X|^2 of whole segments of a trace (segment, frequency), at the
    transform's frequencies from ``low`` to ``high``, or interpolated to those of ``at``."""
    n = 1 + (len(x) - length) // step if len(x) >= length else 0
    parts = np.lib.stride_tricks.sliding_window_view(x, length)[::step][:n] if n else np.empty((0, length))
    if tapered is not None:
        parts = taper(parts, tapered)
    freqs = np.arange((length - 1) // 2 + 1) * rate / length
    held = (freqs >= low) & (freqs <= high)
    size = np.abs(np.fft.rfft(parts)[:, : len(freqs)][:, held])
    if at is not None:
        size = np.array([np.interp(at, freqs[held], s) for s in size]).reshape(len(size), len(at))
    return 2 / rate**2 / (length / rate) * size**2


def mean_spectrum(spectra: np.ndarray, quantile: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation (over n) of the segments whose energy lies strictly within the
    quantiles at either end; NaN if there are none."""
    energy = np.nansum(spectra, axis=1)
    if len(energy):
        low, high = np.nanquantile(energy, [quantile, 1 - quantile])
        spectra = spectra[(energy > low) & (energy < high)]
    if not len(spectra):
        return np.full(spectra.shape[1], np.nan), np.full(spectra.shape[1], np.nan)
    return spectra.mean(0), spectra.std(0)


def transformed(x: np.ndarray, max_lag: int, demean: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """What a trace brings to any correlation up to ``max_lag``: its padded transform and energy."""
    if demean:
        x = x - x.mean(-1, keepdims=True)
    n = 1 << (x.shape[-1] + max(max_lag, 1)).bit_length()
    return np.fft.rfft(x, n), (x * x).sum(-1, keepdims=True)


def correlate_transformed(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], max_lag: int, normalise: bool = True) -> np.ndarray:
    """:func:`correlate` of traces of one length from their transforms."""
    n = 2 * (a[0].shape[-1] - 1)
    full = np.fft.irfft(a[0] * np.conj(b[0]), n)
    out = np.concatenate([full[..., n - max_lag :], full[..., : max_lag + 1]], -1)
    if not normalise:
        return out
    energy = np.sqrt(a[1] * b[1])
    return out / np.where(energy > 0, energy, 1.0)


def correlate(a: np.ndarray, b: np.ndarray, max_lag: int, normalise: bool = True, demean: bool = True) -> np.ndarray:
    """Sums of a(i + lag) b(i) over the last axis by Fourier transform, for lags from -max_lag
    to max_lag; demeaned, and over the root of both energies."""
    return correlate_transformed(transformed(a, max_lag, demean), transformed(b, max_lag, demean), max_lag, normalise)


def classic_sta_lta(x: np.ndarray, short: int, long: int) -> np.ndarray:
    """Ratio of the mean squares of the last ``short`` and ``long`` samples; zero until a
    long window is full."""
    sums = np.concatenate([[0.0], np.cumsum(x * x)])
    out = np.zeros(len(x))
    i = np.arange(long - 1, len(x))
    mean = lambda w: (sums[i + 1] - sums[i + 1 - w]) / w
    if len(i):
        out[i] = mean(short) / np.maximum(mean(long), np.finfo(float).tiny)
    return out


def triggers(ratio: np.ndarray, on: float, off: float) -> list[tuple[int, int]]:
    """Runs [first, last] that begin above ``on`` and go on while above ``off``; a run still
    open at the end is closed there."""
    out, first = [], None
    for i, v in enumerate(ratio.tolist()):
        if first is None and v > on:
            first = i
        elif first is not None and v <= off:
            out.append((first, i - 1))
            first = None
    if first is not None:
        out.append((first, len(ratio) - 1))
    return out


def statistical_reject(spectra: np.ndarray, sigma: float = 2.0) -> np.ndarray:
    """Which stations stay: those whose mean log power lies within so many deviations of
    the others' at all frequencies on average, again and again until none goes."""
    level = np.log(np.maximum(np.abs(spectra), 1e-300)).mean(1)
    kept = np.ones(len(level), bool)
    while kept.sum() > 2:
        mean, dev = level[kept].mean(), level[kept].std()
        now = kept & (np.abs(level - mean) <= sigma * dev + 1e-12)
        if (now == kept).all():
            break
        kept = now
    return kept


def beam_power(spectra: np.ndarray, freqs: np.ndarray, places: np.ndarray, axis: np.ndarray, method: str = "bartlett") -> np.ndarray:
    """Mean beam power over frequencies on the slowness grid axis x axis.

    With R the covariance x x^H of the stations' spectra and e the steering vector
    exp(-2 pi i f p.s) / sqrt(n), Bartlett is e^H R e and Capon 1 / (e^H R^-1 e), with a
    pseudo-inverse that drops singular values under 1e-6 of the largest.
    """
    sx, sy = np.meshgrid(axis, axis, indexing="ij")
    delay = places @ np.stack([sx.ravel(), sy.ravel()])
    total = np.zeros(delay.shape[1])
    for k, f in enumerate(freqs):
        e = np.exp(-2j * np.pi * f * delay) / np.sqrt(len(places))
        x = spectra[:, k]
        if method == "bartlett":
            total += np.abs(e.conj().T @ x) ** 2
        else:
            inverse = np.linalg.pinv(np.outer(x, x.conj()) + 1e-3 * (np.abs(x) ** 2).mean() * np.eye(len(x)), rcond=1e-6)
            total += 1 / np.maximum((e.conj() * (inverse @ e)).sum(0).real, 1e-300)
    return (total / max(1, len(freqs))).reshape(sx.shape)


def local_maxima(grid: np.ndarray, count: int) -> list[tuple[int, int]]:
    """The places not below any of their eight neighbours and above one, largest first;
    plateaus give the middle of their bounding box."""
    padded = np.pad(grid, 1, constant_values=-np.inf)
    around = np.stack([padded[1 + a : 1 + a + grid.shape[0], 1 + b : 1 + b + grid.shape[1]] for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    top = (grid >= around.max(0)) & (grid > np.where(np.isfinite(around), around, np.inf).min(0))
    seen, found = np.zeros_like(top), []
    for i, j in zip(*np.nonzero(top), strict=True):
        if seen[i, j]:
            continue
        front, members = [(i, j)], []
        seen[i, j] = True
        while front:
            a, b = front.pop()
            members.append((a, b))
            for u in range(max(0, a - 1), min(grid.shape[0], a + 2)):
                for v in range(max(0, b - 1), min(grid.shape[1], b + 2)):
                    if top[u, v] and not seen[u, v]:
                        seen[u, v] = True
                        front.append((u, v))
        rows, cols = zip(*members, strict=True)
        found.append(((min(rows) + max(rows)) // 2, (min(cols) + max(cols)) // 2))
    return sorted(found, key=lambda p: (-grid[p], p))[:count]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 0) -> np.ndarray:
    """Least squares without negative weights, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds or 3 * n):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= 1e-10 * max(1.0, np.abs(b).max(initial=0)):
            break
        active[best] = True
        while True:
            s = np.zeros(n)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if s[active].min() > 0:
                x = s
                break
            low = active & (s <= 0)
            step = (x[low] / np.maximum(x[low] - s[low], 1e-300)).min()
            x = x + step * (s - x)
            active &= x > 1e-14
            x[~active] = 0
            if not active.any():
                break
    return x


def deconvolve(beam: np.ndarray, response: np.ndarray, sources: int) -> tuple[list[int], np.ndarray, float]:
    """A beam map as a sum of few shifted array responses: greedy choice of the place where
    the residual fits a response best, then weights by :func:`nnls` over those chosen.
    Returned are the places (flat), their weights and the root mean square of the rest.

    ``response`` has the responses of all places as columns.
    """
    target, chosen = beam.ravel(), []
    weights, rest = np.zeros(0), target
    norm = np.sqrt((response**2).sum(0))
    for _ in range(sources):
        fit = response.T @ rest / np.maximum(norm, 1e-300)
        fit[chosen] = -np.inf
        best = int(np.argmax(fit))
        if fit[best] <= 1e-12:
            break
        chosen.append(best)
        weights = nnls(response[:, chosen], target)
        rest = target - response[:, chosen] @ weights
    return chosen, weights, float(np.sqrt((rest**2).mean())) if rest.size else 0.0


def beam_maps(spectra: np.ndarray, freqs: np.ndarray, delays: np.ndarray, method: str = "beamforming") -> tuple[np.ndarray, np.ndarray]:
    """Absolute and relative beam power of every node, summed over frequencies.

    ``delays`` has each station's delay at each node (seconds). With the covariance R of the n
    stations and unit phases e, the power at a frequency is e^H R e / n^2 or, by Capon,
    1 / (e^H R^-1 e); the relative one is the sum over the stations' mean power, so it is 1
    where all stations agree.
    """
    n = len(spectra)
    total = np.zeros(delays.shape[1])
    for k, f in enumerate(freqs):
        e = np.exp(-2j * np.pi * f * delays)
        x = spectra[:, k]
        if method == "capon":
            inverse = np.linalg.pinv(np.outer(x, x.conj()) + 1e-3 * (np.abs(x) ** 2).mean() * np.eye(n), rcond=1e-6)
            total += 1 / np.maximum((e.conj() * (inverse @ e)).sum(0).real, 1e-300)
        else:
            total += np.abs(e.conj().T @ x) ** 2 / n**2
    power = (np.abs(spectra) ** 2).mean(0).sum()
    return total, total / power if power > 0 else np.zeros_like(total)


def plane_delays(places: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Delays of plane waves of slowness (x, y) at stations; nodes run over y within x."""
    sx, sy = np.meshgrid(x, y, indexing="ij")
    return places @ np.stack([sx.ravel(), sy.ravel()])


def source_delays(places: np.ndarray, x: np.ndarray, y: np.ndarray, slowness: float = 1.0) -> np.ndarray:
    """Delays of waves from sources at (x, y): distance times slowness (matched field)."""
    sx, sy = np.meshgrid(x, y, indexing="ij")
    return slowness * np.hypot(sx.ravel()[None] - places[:, :1], sy.ravel()[None] - places[:, 1:2])


def _around(grid: np.ndarray, size: int, largest: bool) -> np.ndarray:
    """The largest (or smallest) value in the square of so many nodes around each node;
    beyond the edges the grid is mirrored."""
    before, after = size // 2, size - 1 - size // 2
    padded = np.pad(grid, (before, after), mode="symmetric") if before <= min(grid.shape) else np.pad(grid, (before, after), mode="edge")
    for axis in (0, 1):
        view = np.lib.stride_tricks.sliding_window_view(padded, size, axis=axis)
        padded = view.max(-1) if largest else view.min(-1)
    return padded


def peaks(grid: np.ndarray, size: float = 3, threshold: float = 0.0, count: int = 10) -> list[tuple[int, int]]:
    """Nodes that are the largest within ``size`` nodes around them, where the values there
    differ by more than ``threshold``. Adjoining nodes count as one, at the middle of their
    bounding box. The largest ``count``, ties by place."""
    size = max(1, int(size))
    high = _around(grid, size, True)
    top = (grid == high) & (high - _around(grid, size, False) > threshold)
    seen, found = np.zeros_like(top), []
    for start in zip(*np.nonzero(top), strict=True):
        if seen[start]:
            continue
        front, members = [start], []
        seen[start] = True
        while front:
            i, j = front.pop()
            members.append((i, j))
            for at in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)):
                if 0 <= at[0] < grid.shape[0] and 0 <= at[1] < grid.shape[1] and top[at] and not seen[at]:
                    seen[at] = True
                    front.append(at)
        rows, columns = zip(*members, strict=True)
        found.append((int(min(rows) + max(rows)) // 2, int(min(columns) + max(columns)) // 2))
    return sorted(found, key=lambda p: (-grid[p], p))[:count]


def significant(windows: list[list[tuple[int, int, float]]], least: float) -> list[tuple[int, int, float, int, float]]:
    """Peaks (i, j, amplitude) of windows by place: mean amplitude, how often, and mean share.
    A peak counts if its share of its window's amplitudes is over ``least``, which is halved
    until some peak does. Largest first."""
    shares = [(i, j, a, a / sum(p[2] for p in w)) for w in windows for i, j, a in w if sum(p[2] for p in w) > 0]
    if not shares:
        return []
    most = max(s[3] for s in shares)
    while most <= least:
        least /= 2
    held: dict[tuple[int, int], list[tuple[float, float]]] = {}
    for i, j, a, share in shares:
        if share > least:
            held.setdefault((i, j), []).append((a, share))
    out = [(i, j, sum(a for a, _ in v) / len(v), len(v), sum(s for _, s in v) / len(v)) for (i, j), v in held.items()]
    return sorted(out, key=lambda p: (-p[2], p[:2]))
