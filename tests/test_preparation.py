import datetime as dt

import numpy as np
import pytest

from stillwave import config
from stillwave.functions import dsp
from stillwave.functions import traces as T
from stillwave.operators import preparation


def trace(start, *values, rate=1.0):
    return T.Trace(float(start), rate, np.array(values, float))


def test_gaps_are_bridged_and_overlaps_drawn():
    assert T.merge([trace(0, 1, 2), trace(2, 3, 4)], 0).samples.tolist() == [1, 2, 3, 4]
    assert T.merge([trace(0, 0, 1), trace(4, 4, 5)], 2).samples.tolist() == [0, 1, 2, 3, 4, 5]
    assert T.merge([trace(2, 3, 4), trace(0, 1, 2, 3)], 0).samples.tolist() == [1, 2, 3, 4]  # equal overlap
    assert T.merge([trace(0, 0, 9, 9), trace(1, 8, 8, 3)], 2).samples.tolist() == [0, 1, 2, 3]
    assert T.merge([trace(0, 1, 2, 3, 4), trace(1, 2, 3)], 0).samples.tolist() == [1, 2, 3, 4]
    for parts, most in (([trace(0, 1), trace(3, 1)], 1), ([trace(0, 1, 2), trace(1, 5, 6)], 0), ([trace(0, 1), trace(1, 1, rate=2.0)], 9), ([], 9)):
        with pytest.raises(T.TraceError):
            T.merge(parts, most)


def test_zeros_in_gaps():
    assert T.merge_with_zeros([trace(4, 5, 6), trace(0, 1, 2)]).samples.tolist() == [1, 2, 0, 0, 5, 6]
    with pytest.raises(T.TraceError):
        T.merge_with_zeros([trace(0, 1), trace(1, 1, rate=2.0)])


@pytest.mark.parametrize(
    ("method", "start", "expected"),
    [("padded", 0, [4, 4, 4, 0, 0, 0]), ("padded", 3, [0, 0, 0, 4, 4, 4]), ("padded", 1, [0, 4, 4, 4, 0, 0]), ("interpolated", 0, [4, 4, 4, 8 / 3, 4 / 3, 0]),
     ("interpolated", 3, [0, 4 / 3, 8 / 3, 4, 4, 4]), ("interpolated", 1, [0, 4, 4, 4, 2, 0]), ("interpolated", 2, [0, 2, 4, 4, 4, 0]), ("tapered_padded", 0, [4, 4, 0, 0, 0, 0]), ("tapered_padded", 3, [0, 0, 0, 0, 4, 4])],
)
def test_padding(method, start, expected):
    out = T.pad(trace(start, 4, 4, 4), 0.0, 6.0, 6, method, 1.0, 0.5)
    assert out.samples == pytest.approx(expected) and out.start == 0
    with pytest.raises(T.TraceError):
        T.exact_length(np.ones(3), 4)
    assert T.exact_length(np.arange(5), 4).tolist() == [0, 1, 2, 3]


def test_windows_are_checked():
    ready = lambda *parts, tolerance=0.3, gap=2: T.prepare(list(parts), 0.0, 10.0, 1.0, tolerance, gap, "padded")
    ten = trace(0, *range(10))
    assert ready(ten)[1] == 0 and len(ready(trace(0, *range(11)))[0].samples) == 10
    whole, deficit = ready(trace(0, 1, 1, 1, 1), trace(6, 3, 3, 3))
    assert whole.samples == pytest.approx([1, 1, 1, 1, 5 / 3, 7 / 3, 3, 3, 3, 0]) and deficit == 1
    for parts in ([trace(-1, *range(10))], [trace(2, *range(10))], [trace(0, 1, 2, 3)], [], [trace(0, 1), trace(4, *range(6))], [trace(0, *range(20), rate=2.0)]):
        with pytest.raises(T.TraceError):
            ready(*parts)


def test_chunks_of_records(spark):
    """Records that cross windows are cut; gaps are bridged, and a window of few samples says so."""
    day = dt.datetime(2016, 1, 7)
    at = lambda s: day + dt.timedelta(seconds=s)
    value = lambda s: float(s * s % 17)
    records = [("A", at(s), 2.0, [value(2 * s + i) for i in range(n)]) for s, n in ((0, 14), (7, 10), (12.5, 30), (40, 4))] + [("B", at(0), 2.0, [value(i) for i in range(40)])]
    df = spark.createDataFrame(records, "channel string, starttime timestamp_ntz, rate double, samples array<double>").repartition(3)
    spans = spark.createDataFrame([(k, at(10 * k), at(10 * k + 10)) for k in range(5)], "timespan_id long, starttime timestamp_ntz, endtime timestamp_ntz")
    params = config.DatachunkParams(datachunk_sample_tolerance=0.2, max_gap_for_merging=1)
    found = {(r.channel, r.timespan_id): r for r in preparation.chunks(df, spans, ["channel"], params, 2.0, bucket_s=7).collect()}
    assert set(found) == {("A", 0), ("A", 1), ("A", 2), ("A", 4), ("B", 0), ("B", 1)}
    assert found["B", 1].samples == [value(20 + i) for i in range(20)] and found["A", 0].samples == [value(i) for i in range(20)]
    gap = [value(20 + i) for i in range(4)] + [(value(23) + value(25)) / 2] + [value(25 + i) for i in range(15)]
    assert found["A", 1].samples == pytest.approx(gap) and found["A", 1].deficit == 0
    assert found["A", 2].samples is None and "samples" in found["A", 2].problem and found["A", 4].samples is None


def test_response_is_taken_off():
    """A ground motion sent through a sensor's response comes back in the pass band."""
    rate, n = 50.0, 4000
    t = np.arange(n) / rate
    motion = np.sin(2 * np.pi * 2.0 * t) * np.hanning(n)
    poles, zeros = [-4.44 + 4.44j, -4.44 - 4.44j], [0j, 0j]
    f = np.fft.rfftfreq(2 * n, 1 / rate)
    seen = np.fft.irfft(np.fft.rfft(motion, 2 * n) * dsp.response(f, poles, zeros, 800.0), 2 * n)[:n]
    assert np.abs(seen - motion).max() > 10
    back = dsp.remove_response(seen, rate, poles, zeros, 800.0, taper_share=0.02)
    assert np.abs(back - motion)[200:-200].max() < 0.02
