"""Kernels whose sums are added in order: to the last digit the same as SQL's, on traces where a fast
transform's or a matrix product's rounding shows in nine digits."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from stillwave.functions import dsp, ordered
from stillwave.plans import catalogue
from stillwave.plans import signal_queries as S

NAMES = ["dsp10_smoothed_whiten", "dsp10_whiten", "dsp9_preprocess", "dsp4_detrend", "dsp7_bandpass"]


#: Random walks, some of whose whitened samples lie beside a half of the ninth digit.
SEEDS = (14218, 14686, 15528, 20309, 31634, 36975, 15128, 26560)


@pytest.fixture(scope="module")
def traces(tmp_path_factory):
    """These walks, and 400 traces of some thousand counts around an offset."""
    folder = tmp_path_factory.mktemp("traces")
    walks = [np.random.default_rng(seed).standard_normal(64).cumsum() for seed in SEEDS]
    x = np.concatenate([walks, np.random.default_rng(11).standard_normal((400, 64)) * 1000 + 50000]).astype(np.float32)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * 64), pa.array(x.ravel()))
    pq.write_table(pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "label": pa.array([0] * len(x), pa.int32()), "embedding": flat}), folder / "embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_every_digit_is_that_of_sql(spark, traces, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{traces}/embeddings.parquet'")
    expected = dict(con.execute(f"select vec_id, y from ({catalogue.ORACLES[name]})").fetchall())
    found = {r.vec_id: list(r.y) for r in catalogue.QUERIES[name](spark, traces).collect()}
    assert len(found) == 408 and found == expected


def test_the_same_as_the_fast_kernels():
    """Of any length, even or odd; whatever lies beside a trace."""
    p = S.SMOOTH
    smooth = {"min_samples": 4, "ratio_to_bandwidth": 0.15, "max_ratio_to_low": 0.5, "lowpass": 0.5, "taper_samples": 6, "taper_ratio": p.quefrency_filter_taper_length_ratio_to_length_cepstrum}
    for n in (40, 64, 97):
        x = np.random.default_rng(n).standard_normal((5, n))
        x[3] = 0
        for run in (
            lambda k, x: k.detrend(x, 2), lambda k, x: k.detrend(x), lambda k, x: k.mean(x), lambda k, x: k.bandpass(x, 2.0, 16.0, 64.0), lambda k, x: k.bandpass(x, 2.0, 16.0, 64.0, 3, True),
            lambda k, x: k.resample(x, 64.0, 64.0 * 20 / x.shape[-1]), lambda k, x: k.whiten(x, 0.01), lambda k, x: k.whitened(x, 64.0, 4.0, 15.0, 0.02), lambda k, x: k.whitened(x, 64.0, 4.0, 15.0, 0.02, smooth),
        ):
            found = run(ordered, x)
            assert found == pytest.approx(run(dsp, x), abs=1e-9)
            assert np.array_equal(run(ordered, x[1:2])[0], found[1])
    assert ordered.detrend(np.ones((2, 3))).tolist() == [[0.0] * 3] * 2 and ordered.bandpass(np.ones((2, 0)), 2.0, 16.0, 64.0).shape == (2, 0)
