import datetime as dt
import struct

import numpy as np
import pytest

from stillwave import config
from stillwave.sources import inventory, miniseed, soh


def header(npts, encoding, start=(2016, 7, 1, 2, 3, 5000), length=9):
    y, doy, h, m, s, f = start
    head = b"000001D " + b"TD03 " + b"  " + b"HHZ" + b"TD" + struct.pack(">HHBBBBH", y, doy, h, m, s, 0, f)
    head += struct.pack(">Hhh", npts, 100, 1) + bytes([0, 0, 0, 1]) + struct.pack(">i", 0) + struct.pack(">HH", 64, 48)
    return (head + struct.pack(">HHBBBB", 1000, 0, encoding, 1, length, 0)).ljust(64, b"\0")


def steim1(x):
    d = [0, *np.diff(x).tolist()]
    words = [struct.pack(">i", x[0]), struct.pack(">i", x[-1])] + [struct.pack(">i", v) for v in d]
    control = sum(3 << (30 - 2 * (k + 3)) for k in range(len(d)))
    return struct.pack(">I", control) + b"".join(words)


def test_miniseed(spark, tmp_path):
    x = [5, 7, -3, 100000, 2, 2]
    plain = header(6, 3) + struct.pack(">6i", *x)
    data = plain.ljust(512, b"\0") + (header(6, 10) + steim1(x)).ljust(512, b"\0") + header(3, 99).ljust(512, b"\0")
    (tmp_path / "a.mseed").write_bytes(data)
    rows = miniseed.read_miniseed(spark, str(tmp_path), "*.mseed").collect()
    assert [r.samples for r in rows] == [x, x, None] and rows[2].problem == "encoding 99 isn't read"
    assert (rows[0].network, rows[0].station, rows[0].channel, rows[0].rate) == ("TD", "TD03", "HHZ", 100.0)
    assert rows[0].starttime == dt.datetime(2016, 1, 7, 1, 2, 3, 500000)
    index = miniseed.time_series_index(miniseed.read_miniseed(spark, str(tmp_path))).collect()
    assert len(index) == 1 and index[0].records == 3 and index[0].npts == 15
    with pytest.raises(Exception, match="encoding 99"):
        miniseed.read_miniseed(spark, str(tmp_path), strict=True).collect()


def test_steim2_and_broken():
    word = (3 << 30) | sum((v & 15) << (4 * (6 - i)) for i, v in enumerate([0, 1, 2, -3, 4, -5, 6]))
    word = (2 << 30) | (word & ((1 << 28) - 1))
    frame = struct.pack(">I", 3 << 24) + struct.pack(">ii", 10, 15) + struct.pack(">I", word)
    got = miniseed._steim(frame.ljust(64, b"\0"), ">", 7, True)
    assert got.tolist() == [10, 11, 13, 10, 14, 9, 15]
    with pytest.raises(ValueError):
        miniseed._steim(frame.ljust(64, b"\0"), ">", 9, True)


def test_soh_csv(spark, tmp_path):
    """Columns as the instruments write them: their own time, UTC, then values in V, A and C."""
    (tmp_path / "x_Instrument.csv").write_text("Unix,UTCDateTime,V,I,T\n1,2016-01-07T00:00:00,12.0,0.34,25.0\nUnix,UTCDateTime,V,I,T\n2,2016-01-07 00:01:00.250Z,11.9,,24.0\n")
    rows = soh.read_soh(spark, str(tmp_path), "centaur", "instrument").orderBy("datetime").collect()
    assert [tuple(r) for r in rows] == [(dt.datetime(2016, 1, 7), 12.0, 0.34, 25.0), (dt.datetime(2016, 1, 7, 0, 1, 0, 250_000), 11.9, None, 24.0)]
    assert soh.list_files(spark, str(tmp_path), "*.csv").count() == 1
    for station, kind in (("centaur", "weather"), ("mars", "instrument"), ("taurus", "gnsstime")):
        with pytest.raises(ValueError):
            soh.soh_format(station, kind)
    (tmp_path / "y_Instrument.csv").write_text("Unix,UTCDateTime,V,I,T\n1,yesterday,12.0,0.34,25.0\n")
    with pytest.raises(Exception, match="yesterday"):
        soh.read_soh(spark, str(tmp_path), "centaur", "instrument").collect()


def test_soh_currents_skip_nulls(spark, tmp_path):
    (tmp_path / "Instrument_1.csv").write_text("u,t,v,c,a,b,d,e,f\n1,2016-01-07 00:00:00,12000,20,100,,50,25,\n")
    row = soh.read_soh(spark, str(tmp_path), "taurus", "instrument").first()
    assert (row.supply_voltage, row.temperature, row.total_current) == pytest.approx((12.0, 20.0, 0.175))


@pytest.mark.parametrize(("kind", "name"), [("gpstime", "a_GPSTime_1.csv"), ("gnsstime", "a_GNSSTime_1.csv")])
def test_soh_times(spark, tmp_path, kind, name):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / name).write_text("u,t,loc,s,n,ts,pll,unc,dac,q,err\n1,2016-01-07 00:00:00,there,OK,9,Locked,Fine,100,30000,99,-25\n")
    row = soh.read_soh(spark, str(tmp_path), "centaur", kind).first()
    assert (row.time_error, row.time_uncertainty, row.gps_satellites_used, row.timing_status) == (-0.025, 0.1, 9.0, "Locked")


def test_soh_miniseed(spark, tmp_path):
    """Channels meet by time; one that is missing is null."""
    record = lambda channel, x, minute: (header(len(x), 3, (2016, 7, 1, minute, 0, 0)).replace(b"HHZ", channel) + struct.pack(f">{len(x)}i", *x)).ljust(512, b"\0")
    (tmp_path / "s_SOH_1.miniseed").write_bytes(record(b"VEI", [12000, 12100], 0) + record(b"VDT", [21000], 0) + record(b"HHZ", [1], 0))
    (tmp_path / "other.miniseed").write_bytes(record(b"VEI", [1], 5))
    rows = soh.read_soh(spark, str(tmp_path), "centaur", "miniseed_instrument").orderBy("datetime").collect()
    first = dt.datetime(2016, 1, 7, 1, 0)
    assert [tuple(r) for r in rows] == [("TD03", first, 12.0, None, 21.0), ("TD03", first + dt.timedelta(milliseconds=10), 12.1, None, None)]
    assert soh.read_soh(spark, str(tmp_path), "centaur", "miniseed_gpstime").count() == 0


XML = """<?xml version="1.0"?><FDSNStationXML><Network code="TD"><Station code="TD03" startDate="2016-01-01T00:00:00">
<Latitude>32.5</Latitude><Longitude>8.2</Longitude><Elevation>10</Elevation>
<Channel code="HHZ" startDate="2016-02-01T00:00:00" endDate="2018-01-01T00:00:00"><Latitude>32.5</Latitude></Channel>
<Channel code="BHZ" startDate="2016-01-15T00:00:00" endDate="2019-01-01T00:00:00"><Latitude>32.5</Latitude></Channel>
<Channel code="HHE"><Latitude>32.5</Latitude></Channel></Station></Network></FDSNStationXML>"""


def test_stationxml(spark, tmp_path):
    (tmp_path / "inv.xml").write_text(XML)
    rows = {r.component: r for r in inventory.read_stationxml(spark, str(tmp_path / "inv.xml")).collect()}
    assert (rows["Z"].start_date, rows["Z"].end_date) == (dt.datetime(2016, 1, 15), dt.datetime(2019, 1, 1))
    assert (rows["E"].start_date, rows["E"].end_date) == (dt.datetime(2016, 1, 1), dt.datetime(2026, 1, 1))


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a-b", 2, [1.0]), ("a-b", 1, [2.0]), ("a-c", 1, [3.0])], "pair string, t int, y array<double>")
    inventory.export_by_pair(df, str(tmp_path / "x"), ["pair"], "t")
    assert spark.read.parquet(str(tmp_path / "x")).count() == 3
    with pytest.raises(Exception, match="exist"):
        inventory.export_by_pair(df, str(tmp_path / "x"), ["pair"], "t")


def test_days_stay(spark, tmp_path):
    day = lambda d, v: spark.createDataFrame([(dt.datetime(2016, 1, d, 3), v)], "t timestamp_ntz, v int")
    for d, v in ((7, 1), (8, 2), (7, 3)):
        inventory.write_by_day(day(d, v), str(tmp_path / "days"), "t")
    assert sorted((r.doy, r.v) for r in spark.read.parquet(str(tmp_path / "days")).collect()) == [(7, 3), (8, 2)]


def test_configs():
    got = config.parse('[QCOneConfig]\nnull_policy = "pass"\nstrict_gps = "true"\n', "QCOneConfig")
    assert got.null_value and got.strict_gps and not got.uses_gps
    params = config.BeamformingParams(window_length=10.0, window_step_fraction=0.5, slowness_x_min=-2, slowness_x_max=2, slowness_x_step=0.025)
    assert len(params.axis("x")) == 161 and params.step_s == 5.0 and params.central_freq == 0.75
    assert len(config.over_windows(params, 0.1, 10.1, 0.1, 0.1)) == 100
    for bad in ({}, {"window_length": 1.0, "window_length_minimum_periods": 2.0, "window_step": 1.0}):
        with pytest.raises(config.ConfigError):
            config.BeamformingParams(**bad)
    with pytest.raises(config.ConfigError):
        config.parse("[Other]\n", "QCOneConfig")
    with pytest.raises(config.ConfigError):
        config.EventDetectionParams(detection_type="sta_lta")
    assert config.merge_angles((350 - 360, 355), (340, 360)) == (350, 355)
    assert config.split_stations("A:1 B-2") == {"A": 1, "B": 2}


QCONE = """[QCOne]
null_treatment_policy = "fail"
strict_gps = "False"
starttime = 2019-10-01
avg_gps_time_error_max = 0.1
[[QCOne.rejected_times]]
network = "TD"
station = "S1"
component = "Z"
starttime = 2019-10-15
endtime = 2019-10-17
"""


def test_config_files():
    q = config.parse(QCONE)
    assert not q.null_value and not q.strict_gps and q.uses_gps and not q.uses_stats and q.gps_bounds["error_max"] == 0.1
    assert config.moment(q.starttime) == dt.datetime(2019, 10, 1) and q.rejected_times[0].station == "S1"
    b = config.parse('[BeamformingParams]\nmin_freq = 1.2\nmax_freq = 1.3\nslowness_x_min = -2\nslowness_x_max = 2\nslowness_step = 0.025\nwindow_length_minimum_periods = 15\nwindow_step_fraction = 0.5\nprewhiten = "False"\nneighborhood_size_xaxis_fraction = 0.1\nused_component_codes = ["Z"]\nalpha_reg = 3\n')
    assert (len(b.axis("x")), b.window_s, b.step_s, b.neighborhood, b.prewhiten, b.reg_coef_deconv) == (161, 12.5, 6.25, 16.1, False, 3.0)
    s = config.parse('[StackingSchema]\nstarttime = "2019-09-20"\nstacking_length = "6 hours"\nstacking_overlap = "3 hours"\n')
    assert (s.length_s, s.step_s, s.overlap_s) == (21600, 10800, 10800) and config.seconds("1 day 30 min") == 88200
    p = config.parse('[PPSDParams]\nsegment_length = 10\nsegment_step = 5\nfreq_max = 4\nresample = "True"\nresampled_frequency_start = 0.2\nresampled_frequency_stop = 0.5\nresampled_frequency_step = 0.1\n')
    assert p.segment_samples == 240 and p.frequencies[0] == 0.1 and p.frequencies[-1] == 4.0 and p.resampled_frequencies == pytest.approx([0.2, 0.3, 0.4])
    d = config.parse("sampling_rate = 24\ndatachunk_sample_threshold = 0.98\n", "DatachunkParams")
    assert d.datachunk_sample_tolerance == pytest.approx(0.02)
    for text in ('[PPSDParams]\nresample = "True"\n', "[StackingSchema]\nstacking_length = 9\n", '[QCOne]\nnull_treatment_policy = "maybe"\n', "[QCOne]\nwrong = 1\n", "a = 1\nb = 2\n",
                 "[DatachunkParams]\ndatachunk_sample_threshold = 0.9\ndatachunk_sample_tolerance = 0.1\n", '[StackingSchema]\nstacking_length = "6 lunches"\nstacking_step = 1\n', "[[QCTwo.rejected_times]]\nstarttime = 2019-10-15\nendtime = 2019-10-17\n"):
        with pytest.raises(config.ConfigError):
            config.parse(text)
    with pytest.raises(config.ConfigError):
        config.parse(QCONE, "QCTwo")


def test_config_tables(spark):
    tables = {
        config.DatachunkParams: spark.createDataFrame([(3, 24.0)], "id long, sampling_rate double"),
        config.QCOneConfig: spark.createDataFrame([(1, 3, "fail", False)], "id long, datachunk_params_id long, null_policy string, strict_gps boolean"),
    }
    with pytest.raises(config.ConfigError, match="no DatachunkParams with the id 1"):
        config.stored(config.parse(QCONE), tables)
    after = config.stored(config.QCOneConfig(datachunk_params_id=3, strict_gps=True), tables)
    assert sorted(map(tuple, after.collect())) == [(1, 3, "fail", False), (2, 3, "pass", True)]
    assert config.fetch(after, 2).first().strict_gps
    with pytest.raises(LookupError):
        config.fetch(after, 9)
    known = spark.createDataFrame([(7, "TD", "S1", "Z"), (8, "TD", "S2", "Z")], "component_id long, network string, station string, component string")
    assert [tuple(r) for r in config.rejected_components(config.parse(QCONE), known).collect()] == [(7, dt.datetime(2019, 10, 15), dt.datetime(2019, 10, 17))]
    with pytest.raises(LookupError):
        config.rejected_components(config.parse(QCONE.replace("S1", "S9")), known)
    pairs = spark.createDataFrame([(7, 8, "TD", "S1", "Z", "TD", "S2", "Z")], "component_id_a long, component_id_b long, network_a string, station_a string, component_a string, network_b string, station_b string, component_b string")
    both = lambda a, b: config.QCTwoConfig(rejected_times=[{"network_a": "TD", "station_a": a, "component_a": "Z", "network_b": "TD", "station_b": b, "component_b": "Z", "starttime": "2020-01-01", "endtime": "2020-01-02"}])
    assert config.rejected_pairs(both("S1", "S2"), pairs).first().component_id_b == 8
    with pytest.raises(LookupError, match="other way round"):
        config.rejected_pairs(both("S2", "S1"), pairs)
