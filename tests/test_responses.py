"""Instruments' responses: stages, epochs, and the whole preprocessing by its parameters."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillwave import config
from stillwave.functions import dsp
from stillwave.operators import jobs, responses
from stillwave.sources import inventory

FREQS = np.array([0.0, 0.5, 3.0, 10.0, 20.0])
AT = dt.datetime(2020, 1, 1)
S = 2j * np.pi * FREQS


def hour(k):
    return AT + dt.timedelta(hours=k)


@pytest.mark.parametrize("stage, expected", [
    ({"kind": None, "gain": 7.0}, 7.0 + 0 * S),
    ({"kind": "poles_zeros", "domain": "RADIANS", "zeros": [[0, 0], [1, 2]], "poles": [[-3, 4]], "factor": 2.0, "gain": 5.0}, 10 * S * (S - 1 - 2j) / (S + 3 - 4j)),
    ({"kind": "poles_zeros", "domain": "HERTZ", "zeros": [], "poles": [[-3, 0]]}, 1 / (1j * FREQS + 3)),
    ({"kind": "poles_zeros", "domain": "DIGITAL", "zeros": [[0.5, 0]], "poles": [[0.2, 0]], "rate": 50.0}, (np.exp(S / 50) - 0.5) / (np.exp(S / 50) - 0.2)),
    ({"kind": "coefficients", "domain": "DIGITAL", "numerator": [1.0, 0.5], "denominator": [1.0, -0.3, 0.1], "rate": 50.0, "gain": 2.0}, 2 * (1 + 0.5 * np.exp(-S / 50)) / (1 - 0.3 * np.exp(-S / 50) + 0.1 * np.exp(-2 * S / 50))),
    ({"kind": "coefficients", "domain": "RADIANS", "numerator": [1.0, 2.0], "denominator": [3.0]}, (1 + 2 * S) / 3),
    ({"kind": "fir", "numerator": [0.1, 0.4], "symmetry": "ODD", "rate": 50.0, "correction": 0.02}, 0.4 + 0.2 * np.cos(2 * np.pi * FREQS / 50)),
    ({"kind": "fir", "numerator": [0.1, 0.4], "symmetry": "EVEN", "rate": 50.0, "correction": 0.03}, 0.8 * np.cos(np.pi * FREQS / 50) + 0.2 * np.cos(3 * np.pi * FREQS / 50)),
    ({"kind": "fir", "numerator": [0.1, 0.4, 0.2], "symmetry": "NONE", "rate": 50.0}, 0.1 + 0.4 * np.exp(-S / 50) + 0.2 * np.exp(-2 * S / 50)),
])
def test_stages(stage, expected):
    assert dsp.stage_response(stage, FREQS) == pytest.approx(expected, abs=1e-12)


def test_units_and_stages_in_a_row():
    one, two = {"kind": None, "gain": 2.0}, {"kind": "poles_zeros", "domain": "RADIANS", "zeros": [[0, 0]], "poles": [[-1, 0]]}
    h = 2 * S / (S + 1)
    assert dsp.stages_response([one, two], FREQS) == pytest.approx(h)
    assert dsp.stages_response([one, two], FREQS, "m/s/s") == pytest.approx(h * S)
    assert dsp.stages_response([one, two], FREQS, "M")[1:] == pytest.approx((h / np.where(S == 0, 1, S))[1:]) and dsp.stages_response([], FREQS)[2] == 1
    with pytest.raises(ValueError):
        dsp.stage_response({"number": 3, "kind": "fir", "numerator": [1.0]}, FREQS)


EPOCHS = "station string, start_date timestamp_ntz, end_date timestamp_ntz, sensitivity double, unit string, stages array<struct<number:int,kind:string,domain:string,gain:double,numerator:array<double>>>"


def test_epochs_overlap_end_and_lack(spark):
    """Each chunk's sensitivity names its epoch."""
    epochs = [("A", hour(0), hour(10), 1.0), ("A", hour(5), hour(7), 2.0), ("A", hour(10), None, 3.0), ("A", hour(10), hour(11), 4.0), ("B", None, hour(3), 5.0), (None, None, None, 9.0)]
    table = spark.createDataFrame([(*e, "M/S", None) for e in epochs], EPOCHS)
    cases = [("A", 0, 1.0), ("A", 4, 1.0), ("A", 5, 2.0), ("A", 7, 1.0), ("A", 10, 3.0), ("A", 99, 3.0), ("A", -1, None), ("B", -5, 5.0), ("B", 3, None), ("C", 1, None), (None, 1, None), ("A", None, None)]
    chunks = spark.createDataFrame([(i, s, None if k is None else hour(k)) for i, (s, k, _) in enumerate(cases)], "id long, station string, starttime timestamp_ntz").withColumns({"stages": F.lit("x"), "_e": F.lit("y")})
    found = {r.id: r.epoch and r.epoch.sensitivity for r in responses.with_epoch(chunks, table, ["station"]).collect()}
    assert found == {i: e for i, (_, _, e) in enumerate(cases)}
    assert {r.epoch for r in responses.with_epoch(chunks, table.filter("false"), ["station"]).collect()} == {None}


def test_problems_stay_with_their_chunks(spark):
    gain = [(1, None, "DIGITAL", 4.0, None)]
    epochs = spark.createDataFrame([("flat", None, None, 2.0, None, None), ("gain", None, None, None, "M/S", gain), ("none", None, None, None, None, []), ("bad", None, None, 1.0, "M/S", [(1, "fir", "DIGITAL", 1.0, [1.0])])], EPOCHS)
    x = np.random.default_rng(1).standard_normal(64)
    rows = [(s, hour(1), v) for s in ("flat", "gain", "none", "bad", "absent") for v in (x.tolist(), None, [])]
    chunks = spark.createDataFrame(rows, "station string, starttime timestamp_ntz, samples array<double>").withColumns({"problem": F.lit("old"), "_x": F.lit("kept"), "unit": F.lit("u")})
    found = [r for r in responses.without_response(chunks, epochs, 16.0, ["station"]).collect()]
    assert len(found) == 15 and all(r._x == "kept" and r.unit == "u" for r in found)
    by = {(r.station, None if r.samples is None else len(r.samples)): r for r in found}
    assert by["flat", 64].samples == pytest.approx(x / 2) and by["flat", 64].problem is None and by["flat", 0].samples == []
    assert by["gain", 64].samples == pytest.approx(dsp.divide_response(x, 16.0, lambda f: np.full(len(f), 4.0))) and by["gain", 64].samples == pytest.approx(((x - x.mean()) * 0.25 * dsp.taper(np.ones(64))).tolist(), abs=1e-9)
    assert {r.problem for r in found if r.station == "none"} == {"no response"} and {r.problem for r in found if r.station == "absent"} == {"no epoch"}
    assert by["bad", None].samples is None and {r.problem for r in found if r.station == "bad"} == {None, "stage 1 is digital and has no sample rate"}
    only = {r.station: r for r in responses.without_response(chunks, epochs, 16.0, ["station"], sensitivity_only=True).filter("size(samples) > 0").collect()}
    assert set(only) == {"flat", "bad"} and only["bad"].samples == pytest.approx(x)


def test_stationxml_round_trip(spark, tmp_path):
    pz = "<PolesZeros><PzTransferFunctionType>LAPLACE (HERTZ)</PzTransferFunctionType><NormalizationFactor>2</NormalizationFactor><Zero number='0'><Real plusError='0.1'>1</Real><Imaginary>2</Imaginary></Zero><Pole number='0'><Real>-3</Real><Imaginary>0</Imaginary></Pole></PolesZeros><StageGain><Value>5</Value></StageGain>"
    cf = "<Coefficients><CfTransferFunctionType>DIGITAL</CfTransferFunctionType><Numerator>1</Numerator><Numerator>0.5</Numerator><Denominator>2</Denominator></Coefficients><Decimation><InputSampleRate unit='Hz'>100</InputSampleRate><Correction>0.5</Correction></Decimation>"
    xml = f"""<FDSNStationXML><Network code="N"><Station code="S"><Channel code="HHZ" locationCode="00" startDate="2020-01-01T00:00:00.0000Z" endDate="2021-01-01T00:00:00"><Response>
<InstrumentSensitivity><Value>1e9</Value><InputUnits><Name>M/S**2</Name></InputUnits></InstrumentSensitivity><Stage number="2">{cf}</Stage><Stage number="1">{pz}</Stage></Response></Channel>
<Channel code="HHN" locationCode="" startDate="2020-01-01T00:00:00"/></Station></Network></FDSNStationXML>"""
    (tmp_path / "a.xml").write_text(xml)
    found = {r.channel: r for r in inventory.read_responses(spark, str(tmp_path)).collect()}
    z, n = found["HHZ"], found["HHN"]
    assert (z.network, z.station, z.location, z.start_date, z.end_date, z.sensitivity, z.unit) == ("N", "S", "00", dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1), 1e9, "M/S**2")
    first, second = (s.asDict() for s in z.stages)
    assert (first["number"], first["kind"], first["domain"], first["factor"], first["zeros"], first["poles"], first["gain"]) == (1, "poles_zeros", "HERTZ", 2.0, [[1.0, 2.0]], [[-3.0, 0.0]], 5.0)
    assert (second["kind"], second["numerator"], second["denominator"], second["rate"], second["correction"], second["gain"]) == ("coefficients", [1.0, 0.5], [2.0], 100.0, 0.5, None)
    assert n.end_date is None and n.sensitivity is None and not n.stages


PARAMS = {"sampling_rate": 16.0, "prefiltering_low": 0.5, "prefiltering_high": 4.0, "prefiltering_order": 3, "preprocessing_taper_max_length": 2.0, "preprocessing_taper_max_percentage": 0.1}


@pytest.mark.parametrize("more", [{}, {"remove_response": True}, {"response_constant_coefficient": 2.5}, {"response_constant_coefficient": 0.0}, {"remove_response": True, "response_constant_coefficient": 3.0}, {"preprocessing_taper_side": "left"}])
def test_preprocessing_by_parameters(spark, more):
    """Step by step in numpy; a chunk without an epoch is tried again, others are done once."""
    params = config.DatachunkParams(**PARAMS | more)
    x = np.cumsum(np.random.default_rng(3).standard_normal(640))
    held = spark.createDataFrame([(1, 1, x.tolist()), (2, 1, x.tolist())], "component_id long, timespan_id long, samples array<double>")
    spans = spark.createDataFrame([(1, hour(0), hour(0) + dt.timedelta(seconds=20))], "timespan_id long, starttime timestamp_ntz, endtime timestamp_ntz")
    epochs = spark.createDataFrame([(1, None, None, 8.0, "M/S", [(1, None, "DIGITAL", 4.0, None)])], EPOCHS.replace("station string", "component_id long"))
    none = spark.createDataFrame([], held.schema)
    found = {r.component_id: np.array(r.samples) for r in jobs.preprocessed(held, spans, epochs, none, params, 32.0).collect()}
    y = dsp.resample(dsp.detrend(x, 3) - dsp.detrend(x, 3).mean(), 32.0, 16.0)[:320]
    width = min(32, 32)
    edge = np.ones(320)
    edge[:width] = edge[:-width - 1:-1] = 0.5 - 0.5 * np.cos(np.pi * np.arange(width) / (width - 1))
    if params.preprocessing_taper_side == "left":
        edge[160:] = 1
    y = dsp.bandpass(y * edge, 0.5, 4.0, 16.0, 3)
    share = min(2.0 / 20, 0.1 * 0.01, 0.05)
    if params.remove_response:
        y = dsp.divide_response(y, 16.0, lambda f: np.full(len(f), 4.0), share)
    if params.response_constant_coefficient is not None:
        y = y * (params.response_constant_coefficient or 1 / 8.0)
    y = dsp.bandpass(y, 0.5, 4.0, 16.0, 3, zero_phase=True)
    needs = params.remove_response or params.response_constant_coefficient == 0
    assert set(found) == ({1} if needs else {1, 2}) and found[1] == pytest.approx(y, abs=1e-9)
