"""Kernels of short traces by their definitions, each sum added in the order of its places.

Fast transforms and matrix products add in an order that hangs on the machine, and on how many
traces lie side by side; a sum in order doesn't. So results that are rounded to digits are the same
ones everywhere, as those of any engine that adds in order. A transform by its definition takes the
square of a trace's length: these are for traces of some hundred samples, :mod:`dsp` is for all.
Functions have the names and arguments of those there; traces lie along the last axis.
"""

from __future__ import annotations

import math

import numpy as np

from stillwave.functions import dsp


def product(x: np.ndarray, rows: np.ndarray, over: float = 1.0) -> np.ndarray:
    """x @ rows from the first row to the last; each term is divided by ``over``."""
    out = np.zeros((*x.shape[:-1], rows.shape[1]))
    for i, row in enumerate(rows):
        out += x[..., i : i + 1] * row / over
    return out


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers of half the digits each, which add up to x."""
    high = x * 134217729.0
    high = high - (high - x)
    return high, x - high


def fused(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """x @ rows from the first row to the last by fused multiplication and addition: each product
    is rounded only with the sum that it goes into, as inner products mostly are computed."""
    out = np.zeros((*x.shape[:-1], rows.shape[1]))
    with np.errstate(invalid="ignore", over="ignore"):
        high, low = _halves(x)
        for i, row in enumerate(rows):
            there = np.flatnonzero(row)
            if not len(there):
                continue
            part = slice(there[0], None)
            one, (up, down) = row[part], _halves(row[part])
            a, b, v, before = high[..., i : i + 1], low[..., i : i + 1], x[..., i : i + 1] * one, out[..., part]
            lost = b * down - (((v - a * up) - b * up) - a * down)
            after = v + before
            added = after - v
            lost += (v - (after - added)) + (before - added)
            out[..., part] = after + np.where(np.isfinite(lost), lost, 0.0)
    return out


def mean(x: np.ndarray) -> np.ndarray:
    return product(x, np.ones((x.shape[-1], 1))) / x.shape[-1]


def _table(function, first: int, second: int, n: int) -> np.ndarray:
    """``function`` of a whole turn's n-th parts, i times j of them."""
    return np.array([[function(2 * math.pi * i * j / n) for j in range(second)] for i in range(first)])


def transform(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Real and imaginary parts from no frequency to half the rate."""
    n = x.shape[-1]
    return product(x, _table(math.cos, n // 2 + 1, n, n).T), product(-x, _table(math.sin, n // 2 + 1, n, n).T)


def inverse(re: np.ndarray, im: np.ndarray, n: int, over: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """n samples of a transform that is divided by a real spectrum, and multiplied by another."""
    cosine, sine = _table(math.cos, n // 2 + 1, n, n), _table(math.sin, n // 2 + 1, n, n)
    out = np.zeros((*re.shape[:-1], n))
    for k in range(n // 2 + 1):
        both = 1 if k in (0, n / 2) else 2
        term = both * (re[..., k : k + 1] * cosine[k] - im[..., k : k + 1] * sine[k]) / over[..., k : k + 1]
        out += (term if times is None else term * times[k]) / n
    return out


def detrend(x: np.ndarray, order: int = 3) -> np.ndarray:
    """Less the least-squares polynomial (at most a cubic), by polynomials that are orthogonal over the places."""
    n = x.shape[-1]
    if not 0 <= order <= 3:
        raise ValueError(f"no polynomial of order {order}")
    out = x - mean(x)
    if n <= order:
        return out
    t = np.arange(n) - (n - 1) / 2
    for p in (t, t**2 - (n * n - 1) / 12, t**3 - t * (3 * n * n - 7) / 20)[:order]:
        p = p[:, None]
        out = out - fused(x, p) / fused(p.T, p) * p[:, 0]
    return out


def bandpass(x: np.ndarray, low: float | None, high: float | None, rate: float, order: int = 4, zero_phase: bool = False) -> np.ndarray:
    """The filter as the sum of its responses to single impulses, which follow from the difference
    equation of its whole polynomials. For bands that aren't narrow: else rounding grows."""
    n = x.shape[-1]
    if not n:
        return x
    b, a = np.array([1.0]), np.array([1.0])
    for section in dsp.butterworth(low, high, rate, order):
        b, a = np.convolve(b, section[:3]), np.convolve(a, section[3:])
    h: list[float] = []
    for i in range(n):
        h.append((b[i] if i < len(b) else 0.0) - sum(a[k] * h[i - k] for k in range(1, min(i, len(a) - 1) + 1)))
    later = np.arange(n)[None] - np.arange(n)[:, None]
    responses = np.where(later >= 0, np.array(h)[np.maximum(later, 0)], 0.0)
    y = fused(x, responses)
    return fused(y[..., ::-1], responses)[..., ::-1] if zero_phase else y


def resample(x: np.ndarray, rate: float, new_rate: float) -> np.ndarray:
    """Fourier resampling to fewer samples, an even number, by the sum of the cosines that it keeps."""
    n = x.shape[-1]
    m = int(round(n * new_rate / rate))
    if m == n or not n:
        return x
    if m > n or m % 2:
        raise ValueError(f"{n} samples to {m}: give an even number of fewer ones")
    kernel = np.ones((n, m))
    for i in range(n):
        for t in range(m):
            at = t * n / m - i
            for k in range(1, m // 2):
                kernel[i, t] += 2 * math.cos(2 * math.pi * k * at / n)
            kernel[i, t] += math.cos(2 * math.pi * (m // 2) * at / n)
    return product(x, kernel, n)


def _size(re: np.ndarray, im: np.ndarray) -> np.ndarray:
    return np.sqrt(re * re + im * im)


def whiten(x: np.ndarray, water: float = 0.01, quefrency: float | None = None, rate: float = 1.0) -> np.ndarray:
    """The spectrum over its size, raised to at least ``water`` of the largest."""
    if quefrency is not None:
        raise ValueError("a spectrum that is smoothed by its quefrency isn't added in order")
    if not x.shape[-1]:
        return x
    re, im = transform(x)
    size = _size(re, im)
    most = size.max(-1, keepdims=True)
    return np.where(most == 0, 0.0, inverse(re, im, x.shape[-1], np.maximum(size, np.maximum(water * most, 1e-300))))


def _each(function, x: np.ndarray) -> np.ndarray:
    """Python's own function of every number; numpy's may differ in the last place by machine."""
    return np.fromiter(map(function, x.ravel().tolist()), float, x.size).reshape(x.shape)


def _rise(k: np.ndarray, first: int, width: int) -> np.ndarray:
    """:func:`dsp.ramp`."""
    return _each(lambda v: math.sin(v * math.pi / 2) ** 2, np.clip((k - first) / max(1, width - 1), 0.0, 1.0))


def whitened(x: np.ndarray, rate: float, low: float, high: float, water: float, smooth: dict | None = None) -> np.ndarray:
    n = x.shape[-1]
    if not n:
        return x
    places = np.arange(n)
    edge, width = np.minimum(places, n - 1 - places), min(n // 2, int(rate / low))
    re, im = transform(x * np.where(edge < width, 0.5 - 0.5 * _each(math.cos, math.pi * edge / (width - 0.5)), 1.0))
    size = _size(re, im)
    level = np.maximum(size, water * size.max(-1, keepdims=True))
    level[..., 0] = size[..., 0]
    band = None
    if smooth is not None:
        kernel = dsp.smoothing_width(n, rate, low, high, smooth["min_samples"], smooth["ratio_to_bandwidth"], smooth["max_ratio_to_low"])
        log = _each(math.log, np.maximum(level, 1e-300))
        least = log.min(-1, keepdims=True)
        level = _each(math.exp, least + smoothed_log(log - least, n, kernel, smooth["lowpass"], smooth["taper_samples"], smooth["taper_ratio"]))
        axis, k = np.linspace(0, rate / 2, max(1, round(n / 2))), np.arange(n // 2 + 1)
        first, last = (int(np.argmin(np.abs(axis - f))) for f in (low, high))
        band = _rise(k, first - kernel + 1, kernel) * (1 - _rise(k, last, kernel))
    return np.where(size.max(-1, keepdims=True) == 0, 0.0, inverse(re, im, n, np.where(level == 0, 1.0, level), band))


def smoothed_log(log: np.ndarray, n: int, width: int, lowpass: float, taper_samples: int, taper_ratio: float) -> np.ndarray:
    """As in :mod:`dsp`, for the half of a log spectrum of n that isn't its mirror."""
    places = np.arange(n)
    folded = np.minimum(places, n - places)
    log = log[..., folded]
    near = np.zeros((*log.shape[:-1], n - 1))
    for k in range((width - 1) // 2 + 1 - width, (width - 1) // 2 + 1):
        a, b = max(0, -k), min(n - 1, n - 1 - k)
        near[..., a:b] += log[..., 1 + a + k : 1 + b + k]
    near = near / width
    even = np.concatenate([log[..., :1], (near + near[..., ::-1]) / 2], -1)
    kept, fall = round(n * lowpass / 2), max(taper_samples, round(n * taper_ratio))
    quefrencies = product(even, _table(math.cos, n, n, n)) * (1 - _rise(folded, kept, fall))
    return product(quefrencies, _table(math.cos, n, n // 2 + 1, n), n)
