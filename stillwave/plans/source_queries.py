"""Sources, sinks, configurations and jobs: files are written from whole tables and read back
through the library's readers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stillwave import config
from stillwave.functions import columns as C
from stillwave.functions import dsp
from stillwave.operators import chunks as K
from stillwave.operators import jobs, preparation, responses, signals
from stillwave.plans import bindings as B
from stillwave.plans.signal_queries import ccfs, quotients
from stillwave.plans.window_queries import grid_sql
from stillwave.session import scratch, table
from stillwave.sources import headers, inventory, miniseed, soh

PLANS = B.Plans()
DAY = "TIMESTAMP '2024-01-01'"


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every waveform as a trace of a second at 64 samples a second, one after the other."""
    w = B.waveforms(spark, sf_dir)
    start = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("vec_id").cast("decimal(18,6)"))
    code = lambda v: F.lit(v).alias
    return w.select(code("SW")("network"), F.format_string("S%d", F.col("label")).alias("station"), code("")("location"), code("HHZ")("channel"), start.alias("starttime"), F.lit(64.0).alias("rate"), F.col("x").alias("samples"))


@PLANS.add("src4_miniseed_records", f"WITH {B.WAVEFORMS_SQL} SELECT 'S' || label AS station, {DAY} + to_seconds(vec_id) AS starttime, CAST(len(x) AS BIGINT) AS npts, x AS samples FROM wave")
def src4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All waveforms as files of records, decoded again."""
    found = miniseed.decoded(miniseed.encoded(traces(spark, sf_dir)), strict=True)
    return found.select("station", "starttime", "npts", "samples")


@PLANS.add("src2_index", f"WITH {B.WAVEFORMS_SQL} SELECT 'S' || label AS station, min({DAY} + to_seconds(vec_id)) AS starttime, max({DAY} + to_seconds(vec_id) + INTERVAL 984375 MICROSECONDS) AS endtime, CAST(count(*) AS BIGINT) AS files, CAST(sum(len(x)) AS BIGINT) AS npts FROM wave GROUP BY label")
def src2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of those files, added to an empty one, by station."""
    found = miniseed.decoded(miniseed.encoded(traces(spark, sf_dir)))
    schema = miniseed.time_series_index(found.filter("false")).schema
    index = jobs.index(found, spark.createDataFrame([], schema))
    return index.groupBy("station").agg(F.min("starttime").alias("starttime"), F.max("endtime").alias("endtime"), F.count("*").alias("files"), F.sum("npts").alias("npts"))


@PLANS.add("src2_header_index", f"WITH {B.WAVEFORMS_SQL} SELECT 'S' || label AS station, min({DAY} + to_seconds(vec_id)) AS starttime, max({DAY} + to_seconds(vec_id) + INTERVAL 984375 MICROSECONDS) AS endtime, CAST(count(*) AS BIGINT) AS files, CAST(sum(len(x)) AS BIGINT) AS npts FROM wave WHERE label <> 3 GROUP BY label")
def src2_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all stations but one, from files' headers alone."""
    folder = scratch(spark, "miniseed").removeprefix("file://").removeprefix("file:")
    miniseed.write_files(miniseed.encoded(traces(spark, sf_dir)), folder).agg(F.sum("bytes")).collect()
    found = headers.read_headers(spark, folder).filter(F.col("station").isin([f"S{k}" for k in range(10) if k != 3]))
    index = miniseed.time_series_index(found)
    return index.groupBy("station").agg(F.min("starttime").alias("starttime"), F.max("endtime").alias("endtime"), F.count("*").alias("files"), F.sum("npts").alias("npts"))


@PLANS.add("ldr1_checked_loads", f"WITH {B.WAVEFORMS_SQL} SELECT vec_id, x AS samples FROM wave WHERE label IN (2, 5)")
def ldr1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All waveforms as files; those of two labels are then loaded by what was noted of them."""
    folder, noted = (scratch(spark, n).removeprefix("file://").removeprefix("file:") for n in ("artefacts", "noted"))
    miniseed.write_files(miniseed.encoded(traces(spark, sf_dir)), folder).write.parquet(noted)
    time = F.date_format(F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("vec_id").cast("decimal(18,6)")), "yyyy.DDD.HHmmss")
    named = B.waveforms(spark, sf_dir).filter("label in (2, 5)").select("vec_id", F.format_string("SW/S%d/HHZ/SW.S%d..HHZ.%s000000", "label", "label", time).alias("path"))
    loaded = miniseed.checked(named.join(spark.read.parquet(noted), "path", "left"), folder)
    found = miniseed.decoded(loaded.select(F.col("vec_id").cast("string").alias("path"), "content"), strict=True)
    return found.select(F.col("path").cast("long").alias("vec_id"), "samples")


@PLANS.add("src5_stationxml", f"WITH {B.COMPONENTS_SQL} SELECT network, station, component, lat, lon, start_date, end_date FROM component")
def src5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stations as StationXML, a document for each network, read back."""
    c = B.components(spark, sf_dir)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    channel = F.format_string('<Channel code="HH%s" startDate="%s" endDate="%s"><Latitude>%s</Latitude></Channel>', "component", stamp("start_date"), stamp("end_date"), F.col("lat").cast("string"))
    stations = c.groupBy("network", "station", "lat", "lon").agg(F.concat_ws("", F.array_sort(F.collect_list(channel))).alias("channels"))
    station = F.format_string('<Station code="%s"><Latitude>%s</Latitude><Longitude>%s</Longitude><Elevation>0</Elevation>%s</Station>', "station", F.col("lat").cast("string"), F.col("lon").cast("string"), "channels")
    lines = stations.groupBy("network").agg(F.concat_ws("", F.array_sort(F.collect_list(station))).alias("stations"))
    path = scratch(spark, "stationxml")
    value = F.format_string('<FDSNStationXML><Network code="%s">%s</Network></FDSNStationXML>', "network", "stations")
    lines.select(value.alias("value"), F.col("network").alias("file")).write.partitionBy("file").text(path)
    return inventory.read_stationxml(spark, path).select("network", "station", "component", "lat", "lon", "start_date", "end_date")


#: Two instruments: poles and zeros in radians with a gain and a filter, and in Hertz for acceleration.
_FIRST = """<Response><InstrumentSensitivity><Value>%s</Value><InputUnits><Name>M/S</Name></InputUnits></InstrumentSensitivity>
<Stage number="2"><StageGain><Value>%s</Value><Frequency>1</Frequency></StageGain></Stage>
<Stage number="1"><PolesZeros><PzTransferFunctionType>LAPLACE (RADIANS/SECOND)</PzTransferFunctionType><NormalizationFactor>1.5</NormalizationFactor>
<Zero number="0"><Real>0</Real><Imaginary>0</Imaginary></Zero><Zero number="1"><Real>0</Real><Imaginary>0</Imaginary></Zero>
<Pole number="0"><Real>-4.44</Real><Imaginary>4.44</Imaginary></Pole><Pole number="1"><Real>-4.44</Real><Imaginary>-4.44</Imaginary></Pole></PolesZeros><StageGain><Value>2</Value></StageGain></Stage>
<Stage number="3"><FIR><Symmetry>ODD</Symmetry><NumeratorCoefficient i="0">0.25</NumeratorCoefficient><NumeratorCoefficient i="1">0.5</NumeratorCoefficient></FIR>
<Decimation><InputSampleRate>128</InputSampleRate><Correction>0.0078125</Correction></Decimation><StageGain><Value>1</Value></StageGain></Stage></Response>"""
_SECOND = """<Response><Stage number="1"><PolesZeros><InputUnits><Name>M/S**2</Name></InputUnits><PzTransferFunctionType>LAPLACE (HERTZ)</PzTransferFunctionType><NormalizationFactor>3</NormalizationFactor>
<Pole number="0"><Real>-2</Real><Imaginary>0</Imaginary></Pole></PolesZeros><StageGain><Value>%s</Value></StageGain></Stage></Response>"""


_S = lambda f: 2j * np.pi * f
_INSTRUMENTS_SQL = ", ".join(
    f"({k}, {quotients(h)})"
    for k, h in enumerate((
        lambda f: 1.5 * 2 * 100 * _S(f) ** 2 / ((_S(f) + 4.44) ** 2 + 4.44**2) * (0.5 + 0.5 * np.cos(2 * np.pi * f / 128)),
        lambda f: 3 * 40 / (1j * f + 2) * _S(f),
        lambda f: 1.5 * 2 * 300 * _S(f) ** 2 / ((_S(f) + 4.44) ** 2 + 4.44**2) * (0.5 + 0.5 * np.cos(2 * np.pi * f / 128)),
    ))
)


@PLANS.add("dsp8_stationxml_response", f"""WITH {B.WAVEFORMS_SQL}, instrument(number, re, im) AS (VALUES {_INSTRUMENTS_SQL}),
t AS (SELECT vec_id, label, list_transform(range(64), lambda i: (x[i + 1] - list_avg(x)) * CASE WHEN least(i, 63 - i) >= 3 THEN 1 ELSE 0.5 * (1 - cos(pi() * least(i, 63 - i) / 3)) END) AS w,
  CASE WHEN label = 9 THEN NULL WHEN vec_id < 100 THEN 0 WHEN vec_id < 150 THEN 2 WHEN vec_id < 250 THEN 0 WHEN vec_id < 400 THEN 1 END AS number FROM wave),
f AS (SELECT *, list_transform(range(65), lambda k: list_sum(list_transform(range(64), lambda i: w[i + 1] * cos(2 * pi() * k * i / 128)))) AS a,
  list_transform(range(65), lambda k: list_sum(list_transform(range(64), lambda i: -w[i + 1] * sin(2 * pi() * k * i / 128)))) AS b FROM t),
q AS (SELECT vec_id, number, list_transform(range(65), lambda k: a[k + 1] * re[k + 1] - b[k + 1] * im[k + 1]) AS a, list_transform(range(65), lambda k: a[k + 1] * im[k + 1] + b[k + 1] * re[k + 1]) AS b FROM f LEFT JOIN instrument USING (number))
SELECT vec_id, CASE WHEN number IS NULL THEN 'no epoch' END AS problem, CASE WHEN number IS NOT NULL THEN list_transform(range(64), lambda t: round(list_sum(list_transform(range(65), lambda k:
  CASE WHEN k IN (0, 64) THEN 1 ELSE 2 END * (a[k + 1] * cos(2 * pi() * k * t / 128) - b[k + 1] * sin(2 * pi() * k * t / 128)) / 128)), 9) + 0.0) END AS velocity FROM q""")
def dsp8_stationxml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every waveform's response taken off, as StationXML has it for its station and time: two
    epochs, a third one that overlaps the first, none for one station or after the second."""
    found = traces(spark, sf_dir).withColumn("vec_id", F.unix_seconds(F.col("starttime").cast("timestamp_ltz")) - F.unix_seconds(F.lit("2024-01-01").cast("timestamp_ntz").cast("timestamp_ltz")))
    at = lambda s: f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}"
    epochs = [(at(0), at(250), _FIRST % (200, 100)), (at(250), at(400), _SECOND % 40), (at(100), at(150), _FIRST % (600, 300))]
    channels = "".join(f'<Channel code="HHZ" locationCode="" startDate="{a}" endDate="{b}"><SampleRate>64</SampleRate>{r}</Channel>' for a, b, r in epochs).replace("\n", "")
    stations = found.select("network", "station").distinct().filter("station <> 'S9'")
    path = scratch(spark, "responses")
    parts = F.format_string('<FDSNStationXML><Network code="%s"><Station code="%s">%s</Station></Network></FDSNStationXML>', "network", "station", F.lit(channels))
    stations.select(parts.alias("value"), F.col("station").alias("file")).write.partitionBy("file").text(path)
    out = responses.without_response(found, inventory.read_responses(spark, path), 64.0)
    return out.select("vec_id", "problem", F.transform("samples", lambda v: C.rounded(v, 9)).alias("velocity"))


def _csv(df: DataFrame, name: str) -> str:
    path = scratch(df.sparkSession, name)
    df.write.option("header", True).csv(path)
    return path


@PLANS.add("src7_soh_csv", "SELECT date_trunc('second', ts) AS datetime, value AS supply_voltage, CAST(user_id AS DOUBLE) AS total_current, CAST(event_id AS DOUBLE) AS temperature FROM events")
def src7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as an instrument's CSV files, whose own names of columns don't count."""
    e = table(spark, sf_dir, "events")
    path = _csv(e.select(F.lit(0).alias("Unix"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("Time"), "value", "user_id", "event_id"), "soh")
    return soh.read_soh(spark, path, "centaur", "instrument", "*.csv").select("datetime", "supply_voltage", "total_current", "temperature")


@PLANS.add("src9_soh_gps", "SELECT date_trunc('second', ts) AS datetime, event_type AS gps_receiver_status, value / 1000 AS time_error, CAST(user_id AS DOUBLE) / 1000 AS time_uncertainty FROM events")
def src9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as files of GPS times, in two folders that are read as one."""
    e = table(spark, sf_dir, "events")
    text = lambda v: F.lit(v).alias
    rows = e.select(
        text("0")("timestamp"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), text("there")("at"), "event_type", text("9")("satellites"), text("Locked")("timing"),
        text("Fine")("pll"), "user_id", text("1")("dac"), text("99")("quality"), "value",
    )
    paths = [_csv(rows.filter("value < 50"), "gps"), _csv(rows.filter("value >= 50"), "gps")]
    return soh.read_soh(spark, paths, "centaur", "gpstime", "*.csv").select("datetime", "gps_receiver_status", "time_error", "time_uncertainty")


@PLANS.add("src8_soh_miniseed", f"""WITH {B.WAVEFORMS_SQL}, s AS (SELECT label, {DAY} + to_seconds(vec_id) AS t, unnest(range(64)) AS i, unnest(x) AS v FROM wave)
SELECT 'S' || (label // 2) AS station, t + to_microseconds(i * 15625) AS datetime, max(CASE WHEN label % 2 = 0 THEN v END) / 1000 AS supply_voltage, CAST(NULL AS DOUBLE) AS total_current, max(CASE WHEN label % 2 = 1 THEN v END) / 1000 AS temperature
FROM s GROUP BY ALL""")
def src8_miniseed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All waveforms as records of two channels of a health instrument, side by side by time;
    the third channel is in no record."""
    w = B.waveforms(spark, sf_dir)
    channel = F.when(F.col("label") % 2 == 0, "VEI").otherwise("VDT").alias("channel")
    t = traces(spark, sf_dir).select("network", "location", "starttime", "rate", "samples")
    at = w.select(F.format_string("S%d", F.floor(F.col("label") / 2)).alias("station"), channel, (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("vec_id").cast("decimal(18,6)"))).alias("starttime"))
    records = miniseed.decoded(miniseed.encoded(t.join(at, "starttime")), strict=True)
    return soh.side_by_side(records, soh.soh_format("centaur", "miniseed_instrument"))


_FORMATS_SQL = """(VALUES (0, 'centaur', 'instrument', 5), (1, 'centaur', 'gpstime', 11), (2, 'centaur', 'gnsstime', 11), (3, 'centaur', 'environment', 9), (4, 'centaur', 'miniseed_instrument', 3),
(5, 'centaur', 'miniseed_gpstime', 7), (6, 'taurus', 'instrument', 9), (7, 'taurus', 'gpstime', 13), (8, 'taurus', 'environment', 9)) f(i, station, kind, columns)"""


@PLANS.add("src11_formats", f"SELECT user_id, station, kind, columns, count(*) AS records FROM events JOIN {_FORMATS_SQL} ON i = user_id % 9 GROUP BY ALL")
def src11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each device's records with the format that the registry has for its kind of files."""
    known = [(i, s, k, len(soh.soh_format(s, k).columns)) for i, (s, k) in enumerate(soh.FORMATS)]
    formats = spark.createDataFrame(known, "i long, station string, kind string, columns int")
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("records"))
    return e.withColumn("i", F.col("user_id") % 9).join(F.broadcast(formats), "i").select("user_id", "station", "kind", "columns", "records")


@PLANS.add("snk1_days", f"WITH {B.SAMPLES_SQL} SELECT year(ts) AS year, dayofyear(ts) AS doy, count(*) AS n, round(sum(value), 3) AS value FROM sample GROUP BY ALL")
def snk1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples by day; half of the days are then written again, and none is lost."""
    path, s = scratch(spark, "days"), B.samples(spark, sf_dir).select("event_id", "ts", "value")
    inventory.write_by_day(s, path, "ts")
    inventory.write_by_day(s.filter(F.dayofmonth("ts") > 15), path, "ts")
    return spark.read.parquet(path).groupBy("year", "doy").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("value"))


@PLANS.add("snk3_matrix_of_pairs", f"WITH {B.WAVEFORMS_SQL} SELECT a.label || '-' || b.label AS pair, count(*) AS n, min(a.vec_id) AS first FROM wave a JOIN wave b ON b.vec_id BETWEEN a.vec_id AND a.vec_id + 2 GROUP BY ALL")
def snk3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All correlations exported by pair of labels, and read back."""
    path = scratch(spark, "pairs")
    named = ccfs(spark, sf_dir).select(F.format_string("%d-%d", "label_a", "label_b").alias("pair"), "a", "y")
    inventory.export_by_pair(named, path, ["pair"], "a")
    return spark.read.parquet(path).groupBy(F.col("pair").cast("string").alias("pair")).agg(F.count("*").alias("n"), F.min("a").alias("first"))


@PLANS.add("snk4_gps_csv", "SELECT user_id AS station, date_trunc('second', ts) AS datetime, value AS time_error, value * 2 AS time_uncertainty FROM events")
def snk4(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, path = table(spark, sf_dir, "events"), scratch(spark, "gps")
    soh_rows = e.select(F.col("user_id").alias("station"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("datetime"), F.col("value").alias("time_error"), (F.col("value") * 2).alias("time_uncertainty"))
    inventory.export_gps_csv(soh_rows, path)
    return spark.read.option("header", True).schema("station long, datetime timestamp_ntz, time_error double, time_uncertainty double").csv(path)


@PLANS.add("snk2_spectra", f"WITH {B.WAVEFORMS_SQL} SELECT vec_id, label, round(list_sum(list_transform(x, lambda v: v * v)) / 64, 6) + 0.0 AS mean_square FROM wave")
def snk2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of all waveforms, kept as Parquet by label and read back; their sum is the mean
    square of the samples. A second export to the same place is refused."""
    path, w = scratch(spark, "spectra"), B.waveforms(spark, sf_dir)
    found = signals.per_trace(w.select(F.struct("vec_id", "label").alias("k"), "x"), "power_spectrum", 64.0, id="k").select("k.*", "y")
    found.write.partitionBy("label").mode("errorifexists").parquet(path)
    back = spark.read.schema("vec_id long, y array<double>, label int").parquet(path)
    return back.select("vec_id", "label", C.rounded(F.aggregate("y", F.lit(0.0), lambda s, v: s + v)).alias("mean_square"))


_WHOLE = f"""{B.WAVEFORMS_SQL}, chunk AS (SELECT vec_id // 8 AS timespan_id, flatten(list(x ORDER BY vec_id)) AS x FROM wave GROUP BY ALL)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of eight seconds over all traces."""
    at = lambda s: F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=s.cast("decimal(18,6)"))
    ids = B.waveforms(spark, sf_dir).select(F.floor(F.col("vec_id") / 8).alias("timespan_id")).distinct()
    return ids.select("timespan_id", at(F.col("timespan_id") * 8).alias("starttime"), at(F.col("timespan_id") * 8 + 8).alias("endtime"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).select(F.lit(1).cast("long").alias("component_id"), "starttime", "rate", "samples")


PARAMS = config.DatachunkParams(datachunk_sample_tolerance=0.5, max_gap_for_merging=0)


@PLANS.add(
    "dsp1_prepared_chunks",
    f"""WITH {_WHOLE} SELECT timespan_id, CASE WHEN len(x) >= 256 THEN list_transform(list_concat(x, list_transform(range(len(x), 512), lambda i: 0.0)), lambda v: round(v, 6) + 0.0) END AS samples,
CASE WHEN len(x) >= 256 THEN 512 - len(x) END AS deficit, len(x) < 256 AS refused FROM chunk""",
)
def dsp1_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of a second put together in windows of eight, checked, merged and padded."""
    found = preparation.chunks(_records(spark, sf_dir), _spans(spark, sf_dir), ["component_id"], PARAMS, 64.0, bucket_s=64)
    return found.select("timespan_id", F.transform("samples", lambda v: C.rounded(v)).alias("samples"), "deficit", F.col("problem").isNotNull().alias("refused"))


def _stretched(spark: SparkSession, sf_dir: str, length: int) -> tuple[DataFrame, DataFrame]:
    """Every waveform at the start of a window of its own of so many samples: records, windows."""
    first = F.lit("2024-01-01").cast("timestamp_ntz")
    at = lambda k: first + F.make_dt_interval(secs=(k * length / 64.0).cast("decimal(18,6)"))
    w = B.waveforms(spark, sf_dir)
    records = w.select(F.lit(1).cast("long").alias("component_id"), at(F.col("vec_id")).alias("starttime"), F.lit(64.0).alias("rate"), F.col("x").alias("samples"))
    return records, w.select(F.col("vec_id").alias("timespan_id"), at(F.col("vec_id")).alias("starttime"), at(F.col("vec_id") + 1).alias("endtime"))


@PLANS.add("dsp3_interpolated_ends", f"WITH {B.WAVEFORMS_SQL} SELECT vec_id AS timespan_id, list_transform(list_concat(x, list_transform(range(1, 17), lambda k: x[64] * (1 - k / 16.0))), lambda v: round(v, 6) + 0.0) AS samples FROM wave")
def dsp3_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 80 samples of which 64 are there; a line leads down to a zero at the end."""
    params = config.DatachunkParams(datachunk_sample_tolerance=0.3, zero_padding_method="interpolated")
    found = preparation.chunks(*_stretched(spark, sf_dir, 80), ["component_id"], params, 64.0, bucket_s=60)
    return found.select("timespan_id", F.transform("samples", lambda v: C.rounded(v)).alias("samples"))


@PLANS.add("dsp3_tapered_ends", f"WITH {B.WAVEFORMS_SQL} SELECT vec_id AS timespan_id, list_transform(list_concat(list_transform(x, lambda v, i: v * CASE WHEN i > 56 THEN 0.5 * (1 - cos(pi() * (64 - i) / 7)) ELSE 1.0 END), list_transform(range(16), lambda k: 0.0)), lambda v: round(v, 6) + 0.0) AS samples FROM wave")
def dsp3_tapered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with an eighth of a second tapered before the zeros."""
    params = config.DatachunkParams(datachunk_sample_tolerance=0.3, zero_padding_method="tapered_padded", padding_taper_max_length=0.125, padding_taper_max_percentage=0.5)
    found = preparation.chunks(*_stretched(spark, sf_dir, 80), ["component_id"], params, 64.0, bucket_s=60)
    return found.select("timespan_id", F.transform("samples", lambda v: C.rounded(v)).alias("samples"))


@PLANS.add("dsp2_bridged_gaps", f"""WITH {B.WAVEFORMS_SQL} SELECT a.vec_id // 2 AS timespan_id, list_transform(a.x || [a.x[64] + (b.x[1] - a.x[64]) / 3, a.x[64] + (b.x[1] - a.x[64]) * 2 / 3] || b.x, lambda v: round(v, 6) + 0.0) AS samples
FROM wave a JOIN wave b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0""")
def dsp2_bridged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waveforms two by two in windows of 130 samples, with a gap of two samples between."""
    first = F.lit("2024-01-01").cast("timestamp_ntz")
    at = lambda samples: first + F.make_dt_interval(secs=(samples / 64.0).cast("decimal(18,6)"))
    w, pair = B.waveforms(spark, sf_dir), F.floor(F.col("vec_id") / 2)
    records = w.select(F.lit(1).cast("long").alias("component_id"), at(pair * 130 + F.col("vec_id") % 2 * 66).alias("starttime"), F.lit(64.0).alias("rate"), F.col("x").alias("samples"))
    spans = w.select(pair.alias("timespan_id")).distinct().select("timespan_id", at(F.col("timespan_id") * 130).alias("starttime"), at((F.col("timespan_id") + 1) * 130).alias("endtime"))
    params = config.DatachunkParams(datachunk_sample_tolerance=0.1, max_gap_for_merging=2)
    found = preparation.chunks(records, spans, ["component_id"], params, 64.0, bucket_s=60).filter("problem is null")
    return found.select("timespan_id", F.transform("samples", lambda v: C.rounded(v)).alias("samples"))


@PLANS.add("dsp17_source_delays", f"""WITH {B.COMPONENTS_SQL} SELECT component_id, i AS node, round(0.5 * sqrt(pow(i // 5 * 10 - 20 - lon, 2) + pow(i % 5 * 10 - 20 - lat, 2)), 6) + 0.0 AS delay FROM component, range(25) t(i)""")
def dsp17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delays from the sources of a grid of five by five places to every station."""
    nodes = np.arange(-20.0, 21.0, 10.0)

    def run(batches):
        for batch in batches:
            places = np.stack([c.to_numpy() for c in batch.columns[1:]], 1)
            delays = dsp.source_delays(places, nodes, nodes, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(places)), 25))), pa.array(np.tile(np.arange(25), len(places))), pa.array(delays.reshape(-1))], ["component_id", "node", "delay"])

    found = B.components(spark, sf_dir).select("component_id", "lon", "lat").mapInArrow(run, "component_id long, node long, delay double")
    return found.select("component_id", "node", C.rounded(F.col("delay")).alias("delay"))


@PLANS.add("dsp21_beam_peaks")
def dsp21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of average and of all windows of beams, absolute and relative, of each group of 16
    waveforms; held against plane waves and node by node in tests."""
    w = B.waveforms(spark, sf_dir).select(F.floor(F.col("vec_id") / 16).alias("timespan_id"), "vec_id", "x")
    places = w.select("timespan_id", "vec_id", "x", F.cos(F.col("vec_id").cast("double")).alias("px"), F.sin(F.col("vec_id").cast("double") * 1.7).alias("py"))
    every = {f"extract_peaks_{which}_{power}power": True for which in ("average_beamformer", "all_beamformers") for power in ("abs", "rel")}
    params = config.BeamformingParams(min_freq=4.0, max_freq=16.0, slowness_x_min=-0.3, slowness_x_max=0.3, slowness_y_min=-0.3, slowness_y_max=0.3, window_length=0.5, window_step_fraction=0.5, **every)
    return signals.beam_peaks(places, params, 64.0)


@PLANS.add("run5_datachunk_jobs", f"WITH {_WHOLE} SELECT timespan_id, round(list_sum(x) / 512, 6) + 0.0 AS mean, round(list_max(list_concat(x, CASE WHEN len(x) < 512 THEN [0.0] ELSE [] END)), 6) + 0.0 AS max FROM chunk WHERE len(x) >= 256")
def run5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and then statistics, in two increments each."""
    records, spans = _records(spark, sf_dir), _spans(spark, sf_dir)
    chunks = spark.createDataFrame([], "component_id long, timespan_id long, samples array<double>, deficit long")
    for part in (spans.filter("timespan_id < 20"), spans):
        chunks = jobs.datachunks(records, part, chunks, PARAMS, 64.0)
    names = ", ".join(f"{n} double" for n in K.METRICS)
    stats = jobs.statistics(chunks, spark.createDataFrame([], f"component_id long, timespan_id long, {names}"))
    return stats.select("timespan_id", C.rounded(F.col("mean")).alias("mean"), C.rounded(F.col("max")).alias("max"))


@PLANS.add("run6_correlation_jobs", f"WITH {B.WAVEFORMS_SQL} SELECT a.vec_id AS timespan_id, round(list_inner_product(a.x, b.x) / sqrt(list_inner_product(a.x, a.x) * list_inner_product(b.x, b.x)), 6) + 0.0 AS zero_lag FROM (SELECT vec_id, list_transform(x, lambda v: v - list_avg(x)) AS x FROM wave) a JOIN (SELECT vec_id, list_transform(x, lambda v: v - list_avg(x)) AS x FROM wave) b ON b.vec_id = a.vec_id + 1")
def run6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of every waveform with the next, as the second component of its window."""
    w = B.waveforms(spark, sf_dir)
    one = w.select(F.lit(1).cast("long").alias("component_id"), F.col("vec_id").alias("timespan_id"), F.col("x").alias("samples"))
    two = w.select(F.lit(2).cast("long").alias("component_id"), (F.col("vec_id") - 1).alias("timespan_id"), F.col("x").alias("samples"))
    both, pairs = one.unionByName(two), spark.createDataFrame([(1, 2)], "component_id_a long, component_id_b long")
    none = spark.createDataFrame([], "component_id_a long, component_id_b long, timespan_id long, ccf array<double>")
    first = jobs.crosscorrelations(both.filter("timespan_id < 100"), pairs, none, 4)
    return jobs.crosscorrelations(both, pairs, first, 4).select("timespan_id", C.rounded(F.element_at("ccf", 5)).alias("zero_lag"))


QCTWO = """[QCTwo]
starttime = 2024-01-01T00:00:20
endtime = 2024-01-01T00:08:00
[[QCTwo.rejected_times]]
network_a = "SW"
station_a = "S1"
component_a = "Z"
network_b = "SW"
station_b = "S2"
component_b = "Z"
starttime = 2024-01-01T00:01:00
endtime = 2024-01-01T00:03:20
"""


@PLANS.add("run6_qctwo_job", f"""WITH {B.WAVEFORMS_SQL}, p AS (SELECT a.label AS component_id_a, b.label AS component_id_b, a.vec_id AS timespan_id, {DAY} + to_seconds(a.vec_id) AS s FROM wave a JOIN wave b ON b.vec_id = a.vec_id + 1),
v AS (SELECT component_id_a, component_id_b, timespan_id, s >= TIMESTAMP '2024-01-01 00:00:20' AS ok_starttime, s + INTERVAL 1 SECOND <= TIMESTAMP '2024-01-01 00:08:00' AS ok_endtime,
NOT (component_id_a = 1 AND component_id_b = 2 AND s <= TIMESTAMP '2024-01-01 00:03:20' AND s + INTERVAL 1 SECOND >= TIMESTAMP '2024-01-01 00:01:00') AS ok_accepted_time FROM p)
SELECT CAST(component_id_a AS BIGINT) AS component_id_a, CAST(component_id_b AS BIGINT) AS component_id_b, timespan_id, ok_starttime AND ok_endtime AND ok_accepted_time AS is_passing FROM v""")
def run6_qctwo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the correlations of neighbouring waveforms, by their times and by a rejected
    time that the configuration names by its stations."""
    w = B.waveforms(spark, sf_dir)
    one = w.select(F.col("label").cast("long").alias("component_id_a"), F.col("vec_id").alias("timespan_id"))
    two = w.select(F.col("label").cast("long").alias("component_id_b"), (F.col("vec_id") - 1).alias("timespan_id"))
    work = one.join(two, "timespan_id")
    at = lambda c: F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=c.cast("decimal(18,6)"))
    spans = one.select("timespan_id", at(F.col("timespan_id")).alias("starttime"), at(F.col("timespan_id") + 1).alias("endtime"))
    known = work.select("component_id_a", "component_id_b").distinct()
    named = [F.lit("SW").alias(f"network_{s}") for s in "ab"] + [F.format_string("S%d", f"component_id_{s}").alias(f"station_{s}") for s in "ab"] + [F.lit("Z").alias(f"component_{s}") for s in "ab"]
    params = config.parse(QCTWO)
    periods = config.rejected_pairs(params, known.select("*", *named))
    none = spark.createDataFrame([], "component_id_a long, component_id_b long, timespan_id long, ok_starttime boolean, ok_endtime boolean, ok_accepted_time boolean, is_passing boolean")
    return jobs.qc_two(work, spans, periods, none, params).select("component_id_a", "component_id_b", "timespan_id", "is_passing")


@PLANS.add("run7_event_jobs", f"WITH {B.WAVEFORMS_SQL} SELECT vec_id AS timespan_id, list_position(list_transform(x, lambda v: abs(v) >= 0.3), true) - 1 AS first, round(list_max(list_transform(x, lambda v: abs(v))), 6) + 0.0 AS pgv FROM wave WHERE list_max(list_transform(x, lambda v: abs(v))) >= 0.3")
def run7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spikes of every waveform, joined over the whole of it: one event for each that has any."""
    w = B.waveforms(spark, sf_dir).select(F.lit(1).cast("long").alias("component_id"), F.col("vec_id").alias("timespan_id"), F.col("x").alias("samples"))
    params = config.EventDetectionParams(detection_type="amplitude_spike", peak_ground_velocity_threshold=0.3)
    done = spark.createDataFrame([], "component_id long, timespan_id long")
    found, _ = jobs.events(w, done, params, 64.0)
    return found.groupBy("timespan_id").agg(F.min("first").alias("first"), C.rounded(F.max("pgv")).alias("pgv"))


@PLANS.add("run11_gps_job", f"""WITH {B.SAMPLES_SQL}, {B.SPANS_SQL} SELECT CAST(user_id AS BIGINT) AS component_id, span.timespan_id, round(avg(value), 6) + 0.0 AS error FROM events JOIN span ON ts >= starttime AND ts <= endtime GROUP BY ALL""")
def run11(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("station"), F.col("ts").alias("datetime"), F.col("value").alias("time_error"), F.col("value").alias("time_uncertainty"))
    components = e.select("station").distinct().withColumn("component_id", F.col("station").cast("long"))
    none = spark.createDataFrame([], "component_id long, timespan_id long, error double, uncertainty double")
    found = jobs.soh(e, components, B.spans_of_events(spark, sf_dir), none, bucket_s=86_400)
    return found.select("component_id", "timespan_id", C.rounded(F.col("error")).alias("error"))


@PLANS.add("run12_grid_job", f"SELECT CAST(row_number() OVER (ORDER BY starttime) AS BIGINT) AS timespan_id, starttime FROM ({grid_sql(1800, 1800)})")
def run12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of the events' time in two increments."""
    grid_table = spark.createDataFrame([], "timespan_id long, starttime timestamp_ntz, midtime timestamp_ntz, endtime timestamp_ntz")
    start, end = B.period(spark, sf_dir)
    for until in ("2024-01-03", end):
        grid_table = jobs.timespans(grid_table, start, until, 1800)
    return grid_table.select("timespan_id", "starttime")


QCONE = """[QCOne]
null_treatment_policy = "fail"
starttime = 2024-01-01
endtime = 2024-02-01
signal_energy_max = 100.5
[[QCOne.rejected_times]]
network = "EUROPE"
station = "NATION_3"
component = "Z"
starttime = 2024-01-05
endtime = 2024-01-07
[[QCOne.rejected_times]]
network = "AFRICA"
station = "NATION_20"
component = "N"
starttime = 2024-01-10
endtime = 2024-01-11
"""


@PLANS.add("cfg3_rejected_times", f"""WITH {B.COMPONENTS_SQL} SELECT component_id, s AS starttime, e AS endtime FROM component
JOIN (VALUES ('NATION_3', 'Z', TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-07'), ('NATION_20', 'N', TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-11')) r(n, c, s, e) ON station = n AND component = c""")
def cfg3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rejected times of a configuration file, with the ids of their components."""
    return config.rejected_components(config.parse(QCONE), B.components(spark, sf_dir))


_QCONE_OF = """[QCOne]
null_treatment_policy = "%s"
starttime = 2024-01-01
endtime = 2024-02-01
signal_energy_max = %s
[[QCOne.rejected_times]]
network = "EUROPE"
station = "%s"
component = "Z"
starttime = 2024-01-05
endtime = 2024-01-06
"""


def by_row(df: DataFrame, schema: str, of) -> DataFrame:
    """What ``of`` makes of each row, a tuple; a helper for configurations, which are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [of(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    names, kinds = zip(*((f.name, to_arrow_type(f.dataType)) for f in df.sparkSession.createDataFrame([], schema).schema), strict=True)
    return df.mapInArrow(run, schema)


@PLANS.add("cfg2_parsed", "SELECT s_suppkey, CASE WHEN s_nationkey > 12 THEN 'fail' ELSE 'pass' END AS null_policy, false AS strict_gps, true AS uses_stats, false AS uses_gps, s_acctbal AS energy_max, s_name AS rejected, TIMESTAMP '2024-01-01' AS starttime FROM supplier")
def cfg2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration file of each supplier's values, parsed again."""
    s = table(spark, sf_dir, "supplier")
    policy = F.when(F.col("s_nationkey") > 12, "fail").otherwise("pass")
    text = F.format_string(_QCONE_OF, policy, F.col("s_acctbal").cast("decimal(12,2)").cast("string"), "s_name")

    def parsed(key: int, toml: str) -> tuple:
        q = config.parse(toml, "QCOne")
        return key, q.null_policy, q.strict_gps, q.uses_stats, q.uses_gps, q.bounds["energy_max"], q.rejected_times[0].station, config.moment(q.starttime)

    return by_row(s.select("s_suppkey", text.alias("text")), "s_suppkey long, null_policy string, strict_gps boolean, uses_stats boolean, uses_gps boolean, energy_max double, rejected string, starttime timestamp_ntz", parsed)


@PLANS.add("cfg4_stored", "SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(s_nationkey + 1 AS DOUBLE) AS sampling_rate FROM supplier WHERE s_suppkey = (SELECT min(s_suppkey) FROM supplier) UNION ALL SELECT CAST(max(s_suppkey) + 1 AS BIGINT), 12.0 FROM supplier")
def cfg4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration stored beside those of all suppliers, under the next id, and fetched with the first."""
    held = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), (F.col("s_nationkey") + 1).cast("double").alias("sampling_rate"))
    ends = held.agg(F.min("id").alias("first"), F.max("id").alias("last")).first()
    after = config.stored(config.DatachunkParams(sampling_rate=12.0), {config.DatachunkParams: held})
    return config.fetch(after, ends.first).unionByName(config.fetch(after, ends.last + 1))


@PLANS.add("cfg6_axes", f"WITH {B.WAVEFORMS_SQL} SELECT CAST(i AS INTEGER) AS node, round(CAST(-2 + 0.025 * i AS DOUBLE), 6) + 0.0 AS slowness, count(*) AS n FROM (SELECT floor((v + 2) / 0.025 + 0.5) AS i FROM (SELECT CAST(unnest(x) AS DOUBLE) AS v FROM wave)) GROUP BY i")
def cfg6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many samples of all waveforms are nearest to each node of a configuration's slowness axis."""
    text = '[BeamformingParams]\nslowness_x_min = -2\nslowness_x_max = 2\nslowness_step = 0.025\nwindow_length = 10\nwindow_step = 5\n'
    axis = config.parse(text).axis("x")
    nodes = spark.createDataFrame(list(enumerate(axis)), "node int, slowness double")
    near = B.waveforms(spark, sf_dir).select(F.explode("x").alias("v")).select(F.floor((F.col("v") - axis[0]) / 0.025 + 0.5).cast("int").alias("node"))
    return near.groupBy("node").agg(F.count("*").alias("n")).join(F.broadcast(nodes), "node").select("node", C.rounded(F.col("slowness")).alias("slowness"), "n")


@PLANS.add("cfg5_stacking_windows", f"SELECT starttime, endtime FROM ({grid_sql(10800, 21600)})")
def cfg5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid that a stacking schema over the events' time asks for."""
    from stillwave.operators import grid

    a, b = (t.replace(" ", "T") for t in B.period(spark, sf_dir))
    schema = config.parse(f'[StackingSchema]\nstarttime = "{a}"\nendtime = "{b}"\nstacking_length = "6 hours"\nstacking_overlap = "3 hours"\n')
    start, end = (f"{config.moment(t):%Y-%m-%d %H:%M:%S}" for t in (schema.starttime, schema.endtime))
    return grid.timespans(spark, start, end, schema.length_s, overlap_s=schema.overlap_s, across_midnight=True).select("starttime", "endtime")


@PLANS.add("st3_config_merges", "SELECT p_partkey, CASE WHEN p_size < 12 THEN CAST(greatest(p_size, 5) AS DOUBLE) END AS low, CASE WHEN p_size < 12 THEN CAST(12 AS DOUBLE) END AS high, CASE WHEN p_size < 15 THEN CAST(340 + p_size AS DOUBLE) WHEN p_size >= 20 THEN CAST(330 AS DOUBLE) END AS angle_low, CASE WHEN p_size < 15 OR p_size >= 20 THEN CAST(355 AS DOUBLE) END AS angle_high FROM part")
def st3_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What intervals of slowness and of angle share that begin at each part's size; null if nothing."""

    def shared(merge, a: tuple, b: tuple) -> tuple:
        try:
            return merge(a, b)
        except config.ConfigError:
            return None, None

    of = lambda key, k: (key, *shared(config.merge_intervals, (float(k), 12.0), (5.0, 20.0)), *shared(config.merge_angles, (-20.0 + k, 355.0), (330.0, 360.0)))
    return by_row(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey long, low double, high double, angle_low double, angle_high double", of)


@PLANS.add("sc12_vote_weights", "SELECT s_suppkey, 'S' || s_suppkey AS station, CAST(s_nationkey + 1 AS DOUBLE) AS weight, CAST(2 AS DOUBLE) AS other FROM supplier")
def sc12_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes by station, as a configuration of each supplier writes them."""
    text = F.format_string('[EventConfirmationParams]\nvote_weight = ["S%d:%d T2-2", "T10 1"]\n', "s_suppkey", F.col("s_nationkey") + 1)

    def weights(key: int, toml: str) -> tuple:
        found = config.parse(toml).weights
        station = next(iter(found))
        return key, station, found[station], found["T2"]

    return by_row(table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text")), "s_suppkey long, station string, weight double, other double", weights)
