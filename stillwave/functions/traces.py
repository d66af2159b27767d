"""Traces of one channel put together into a window: checks, merging, padding. In numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Part of a sample by which times may miss the grid.
JITTER = 1e-3


class TraceError(ValueError):
    """Traces that don't make up the window asked for."""


@dataclass
class Trace:
    """Samples from ``start`` (seconds) on, so many a second."""

    start: float
    rate: float
    samples: np.ndarray

    @property
    def end(self) -> float:
        """The time of the last sample."""
        return self.start + (len(self.samples) - 1) / self.rate


def expected_samples(start: float, end: float, rate: float, tolerance: float = 0.0) -> tuple[int, int, int]:
    """The whole window's samples, and the least and most that are accepted; fractions go."""
    n = int(round((end - start) * rate * 1e6) / 1e6)
    return n, int(n * (1 - tolerance)), int(n * (1 + tolerance))


def taper(x: np.ndarray, rate: float, max_length: float | None, max_share: float | None, side: str = "both") -> np.ndarray:
    """A half cosine from 0 to 1 at the sides, over the shortest of so many seconds, so large
    a share of the samples, and half of them."""
    width = int(min([len(x) // 2, *(len(x) * v for v in [max_share] if v is not None), *(rate * v for v in [max_length] if v is not None)]))
    out = np.array(x, float)
    if width > 0:
        rise = 0.5 * (1 - np.cos(np.pi * np.arange(width) / max(1, width - 1)))
        if side in ("left", "both"):
            out[:width] *= rise
        if side in ("right", "both"):
            out[-width:] *= rise[::-1]
    return out


def _between(a: float, b: float, n: int) -> np.ndarray:
    """So many values on the line from a to b, without these."""
    return np.linspace(a, b, n + 2)[1:-1]


def merge(traces: list[Trace], max_gap: int | None) -> Trace:
    """Traces of one rate as one. Gaps are bridged by straight lines. Where two traces overlap
    with equal samples either counts; else a line replaces the overlap, and a trace within
    another is left out. A gap or unequal overlap of over ``max_gap`` samples is an error."""
    if not traces:
        raise TraceError("no trace")
    if len({t.rate for t in traces}) > 1:
        raise TraceError("traces of several rates")
    first, *rest = sorted(traces, key=lambda t: (t.start, -len(t.samples)))
    data = np.array(first.samples, float)
    for t in rest:
        at = int(round((t.start - first.start) * t.rate))
        over = len(data) - at
        shared = min(over, len(t.samples))
        if over <= 0:
            _short_enough(-over, max_gap)
            data = np.concatenate([data, _between(data[-1], t.samples[0], -over), t.samples])
            continue
        same = np.array_equal(data[at : at + shared], t.samples[:shared])
        if not same:
            _short_enough(int((data[at : at + shared] != t.samples[:shared]).sum()), max_gap)
        if len(t.samples) <= over:
            continue
        tail = t.samples[over:]
        middle = data[at:] if same else _between(data[at - 1] if at else data[0], tail[0], over)
        data = np.concatenate([data[:at], middle, tail])
    return Trace(first.start, first.rate, data)


def _short_enough(samples: int, most: int | None) -> None:
    if most is not None and samples > most:
        raise TraceError(f"a gap or overlap of {samples} samples, over {most}")


def merge_with_zeros(traces: list[Trace]) -> Trace:
    """Traces as one, with zeros in gaps and where they overlap with unequal samples."""
    first = min(traces, key=lambda t: t.start)
    if len({t.rate for t in traces}) > 1:
        raise TraceError("traces of several rates")
    places = [(int(round((t.start - first.start) * t.rate)), t.samples) for t in traces]
    data = np.full(max(at + len(x) for at, x in places), np.nan)
    clash = np.zeros(len(data), bool)
    for at, x in places:
        held = data[at : at + len(x)]
        clash[at : at + len(x)] |= ~np.isnan(held) & (held != x)
        data[at : at + len(x)] = x
    return Trace(first.start, first.rate, np.where(clash | np.isnan(data), 0.0, data))


def exact_length(x: np.ndarray, expected: int) -> np.ndarray:
    """The first so many samples; fewer are an error."""
    if len(x) < expected:
        raise TraceError(f"{len(x)} samples of {expected}")
    return x[:expected]


def pad(trace: Trace, start: float, end: float, expected: int, method: str = "padded", max_length: float | None = None, max_share: float | None = None) -> Trace:
    """The trace from ``start`` on with ``expected`` samples. "padded" puts zeros at the ends,
    "tapered_padded" tapers the sides that need some first, and "interpolated" draws lines
    down to a zero at the window's first and last sample."""
    before = int(np.floor((trace.start - start) * trace.rate + JITTER))
    after = max(0, expected - before - len(trace.samples))
    x = trace.samples
    if before < 0:
        raise TraceError("the trace begins before the window")
    if method == "tapered_padded":
        sides = ["left"] * (before > 0) + ["right"] * (after > 0)
        if sides:
            x = taper(x, trace.rate, max_length, max_share, sides[0] if len(sides) == 1 else "both")
    if method == "interpolated":
        head = np.concatenate([[0.0], _between(0.0, x[0], before - 1)]) if before else x[:0]
        tail = np.concatenate([_between(x[-1], 0.0, after - 1), [0.0]]) if after else x[:0]
    elif method in ("padded", "tapered_padded"):
        head, tail = np.zeros(before), np.zeros(after)
    else:
        raise TraceError(f"no padding method {method}")
    return Trace(start, trace.rate, exact_length(np.concatenate([head, x, tail]), expected))


def prepare(
    traces: list[Trace], start: float, end: float, rate: float, tolerance: float, max_gap: int, method: str, max_length: float | None = None, max_share: float | None = None
) -> tuple[Trace, int]:
    """One trace that fills the window, and how many samples it lacked: the traces are checked
    (one rate, the expected one; within the window; enough samples, and not too many), merged,
    freed of a last sample too many, and padded."""
    if not traces:
        raise TraceError("no data in the window")
    if {t.rate for t in traces} != {rate}:
        raise TraceError(f"rates {sorted({t.rate for t in traces})} where {rate} is expected")
    if min(t.start for t in traces) < start - JITTER / rate:
        raise TraceError("a trace begins before the window")
    if max(t.end for t in traces) > end + JITTER / rate:
        raise TraceError("a trace ends after the window")
    expected, least, most = expected_samples(start, end, rate, tolerance)
    count = sum(len(t.samples) for t in traces)
    if not least <= count <= max(most, expected + 1):
        raise TraceError(f"{count} samples where {least} to {most} are accepted")
    whole = merge(traces, max_gap) if len(traces) > 1 else traces[0]
    if len(whole.samples) == expected + 1:
        whole = Trace(whole.start, rate, whole.samples[:expected])
    deficit = max(0, expected - len(whole.samples))
    if deficit or whole.start - start >= 1 / rate:
        whole = pad(whole, start, end, expected, method, max_length, max_share)
    return whole, deficit
