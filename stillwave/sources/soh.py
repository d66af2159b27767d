"""State-of-health files: declared formats, a reader of CSV and one of miniSEED."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwave.sources.miniseed import read_miniseed


@dataclass(frozen=True)
class SohFormat:
    """The columns of a CSV file in order, or the channels of a miniSEED file; its glob; what
    is kept, by new name: the source and a divisor; and sums that are kept under a name."""

    columns: tuple[str, ...]
    glob: str
    kept: dict[str, tuple[str, float]]
    summed: dict[str, tuple[tuple[str, ...], float]] = field(default_factory=dict)
    strings: frozenset[str] = frozenset()
    channels: bool = False


# The files' columns in order, their globs, and the units they come in.
_HEAD = ("timestamp", "utc_datetime")
_GPS_HEAD = (*_HEAD, "earth_location", "gps_receiver_status", "gps_satellites_used")
_TEXT = frozenset({"timestamp", "earth_location", "gps_receiver_status", "timing_status", "phase_lock_loop_status", "gps_last_update_time"})
_TIMING = ("timing_status", "phase_lock_loop_status", "time_uncertainty_ns", "timing_dac_count")
_GPS_KEPT = {c: (c, 1.0) for c in ("gps_receiver_status", "gps_satellites_used", "timing_status", "phase_lock_loop_status", "timing_dac_count")}
#: The files' users expect nanoseconds divided by 1000 under the name of milliseconds.
_GPS_TIMES = {"time_error": ("time_error_ns", 1000.0), "time_uncertainty": ("time_uncertainty_ns", 1000.0)}
_CENTAUR_GPS = (*_GPS_HEAD, *_TIMING, "time_quality", "time_error_ns")
_CENTAUR_GPS_KEPT = _GPS_KEPT | {"time_quality": ("time_quality", 1.0)} | _GPS_TIMES
_CURRENTS = ("nmx_bus_current_ma", "sensor_current_ma", "serial_port_current_ma", "controller_current_ma", "digitizer_current_ma")
_CENTAUR_ENVIRONMENT = ("maximum_mass_position_1_mv", *(f"sensor_soh_voltage_{k}_mv" for k in (1, 2, 3)), *(f"external_soh_voltage_{k}_v" for k in (1, 2, 3)))
_TAURUS_ENVIRONMENT = (*(f"external_soh_voltage_{k}_v" for k in (1, 2, 3, 4)), *(f"sensor_soh_voltage_{k}_v" for k in (1, 2, 3)))
_AS_IS = lambda names: {n: (n, 1.0) for n in names}

#: By station type and kind of data.
FORMATS: dict[tuple[str, str], SohFormat] = {
    ("centaur", "instrument"): SohFormat((*_HEAD, "supply_voltage", "total_current", "temperature"), "*Instrument*.csv", _AS_IS(("supply_voltage", "total_current", "temperature"))),
    ("centaur", "gpstime"): SohFormat(_CENTAUR_GPS, "*GPSTime*.csv", _CENTAUR_GPS_KEPT, strings=_TEXT),
    ("centaur", "gnsstime"): SohFormat(_CENTAUR_GPS, "*GNSSTime*.csv", _CENTAUR_GPS_KEPT, strings=_TEXT),
    ("centaur", "environment"): SohFormat((*_HEAD, *_CENTAUR_ENVIRONMENT), "*EnvironmentSOH*.csv", _AS_IS(_CENTAUR_ENVIRONMENT)),
    ("centaur", "miniseed_instrument"): SohFormat(
        ("VEI", "VEC", "VDT"), "*SOH_*.miniseed",
        {"supply_voltage": ("VEI", 1000.0), "total_current": ("VEC", 1000.0), "temperature": ("VDT", 1000.0)}, channels=True,
    ),
    ("centaur", "miniseed_gpstime"): SohFormat(
        ("GST", "GNS", "LCQ", "GPL", "VCO", "LCE", "TIME_UNCERTAINTY"), "*SOH_*.miniseed",
        {"gps_receiver_status": ("GST", 1.0), "gps_satellites_used": ("GNS", 1.0), "timing_status": ("LCQ", 1.0), "phase_lock_loop_status": ("GPL", 1.0),
         "timing_dac_count": ("VCO", 1.0), "time_error": ("LCE", 1000.0), "time_uncertainty": ("TIME_UNCERTAINTY", 1.0)}, channels=True,
    ),
    ("taurus", "instrument"): SohFormat(
        (*_HEAD, "supply_voltage_mv", "temperature", *_CURRENTS), "*Instrument*.csv",
        {"supply_voltage": ("supply_voltage_mv", 1000.0), "temperature": ("temperature", 1.0)}, {"total_current": (_CURRENTS, 1000.0)},
    ),
    ("taurus", "gpstime"): SohFormat(
        (*_GPS_HEAD, "gps_pdop", "gps_tdop", *_TIMING, "time_error_ns", "gps_last_update_time"), "*GPSTime*.csv", _GPS_KEPT | _GPS_TIMES, strings=_TEXT,
    ),
    ("taurus", "environment"): SohFormat((*_HEAD, *_TAURUS_ENVIRONMENT), "*EnvironmentSOH*.csv", _AS_IS(_TAURUS_ENVIRONMENT)),
}


def soh_format(station: str, kind: str) -> SohFormat:
    """The format by names; a wrong one is told apart from a pair that doesn't go together."""
    stations, kinds = sorted({s for s, _ in FORMATS}), sorted({k for _, k in FORMATS})
    if station not in stations:
        raise ValueError(f"no station type {station}; known are {stations}")
    if kind not in kinds:
        raise ValueError(f"no kind of state of health {kind}; known are {kinds}")
    if (station, kind) not in FORMATS:
        raise ValueError(f"{station} has no {kind}; it has {sorted(k for s, k in FORMATS if s == station)}")
    return FORMATS[station, kind]


def null_as_zero_sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])


def converted(form: SohFormat) -> list[Column]:
    """The kept columns in their new units, and the sums."""
    values = [(F.col(source) if by == 1.0 else F.col(source) / F.lit(by)).alias(name) for name, (source, by) in form.kept.items()]
    return values + [(null_as_zero_sum([F.col(c) for c in cs]) / F.lit(by)).alias(name) for name, (cs, by) in form.summed.items()]


def read_soh(spark: SparkSession, paths: str | list[str], station: str, kind: str, pattern: str | None = None) -> DataFrame:
    """All files of a kind under the paths, by the kind's glob or another ``pattern``:
    ``datetime`` (UTC) and the converted columns.

    Columns count by their place, whatever the first line calls them. Lines that repeat the
    header, or hold no time at all, are left out; one whose time can't be read is an error. An
    empty folder is an error of Spark's own. MiniSEED kinds also give ``station``.
    """
    form = soh_format(station, kind)
    if form.channels:
        return side_by_side(read_miniseed(spark, paths, pattern or form.glob), form)
    schema = ", ".join(f"{c} {'string' if c in ('timestamp', 'utc_datetime') or c in form.strings else 'double'}" for c in form.columns)
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").option("pathGlobFilter", pattern or form.glob).option("recursiveFileLookup", True).csv(paths)
    raw = raw.filter(F.col("utc_datetime").isNotNull() & ~F.lower("utc_datetime").contains("time"))
    text = F.trim(F.regexp_replace("utc_datetime", "[TZ]|UTC|\\+00:?00$", " "))
    time = F.try_to_timestamp(F.substring_index(text, ".", 1), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    micros = F.rpad(F.regexp_extract(text, "\\.([0-9]{1,6})", 1), 6, "0").try_cast("int")
    time = time + F.make_dt_interval(secs=F.coalesce(micros, F.lit(0)).cast("decimal(18,6)") / 1_000_000)
    time = F.when(time.isNull(), F.raise_error(F.concat(F.lit("no time in a state-of-health file: "), F.col("utc_datetime"))).cast("timestamp_ntz")).otherwise(time)
    return raw.select(time.alias("datetime"), *converted(form))


def side_by_side(records: DataFrame, form: SohFormat) -> DataFrame:
    """Samples of the used channels of records side by side, by station and time; a channel
    without a sample at a time is null there. Of samples that stand twice the larger counts."""
    records = records.filter(F.col("channel").isin(list(form.columns)) & (F.col("rate") > 0))
    at = records.select("station", "channel", "starttime", "rate", F.posexplode("samples").alias("i", "value"))
    time = F.col("starttime") + F.make_dt_interval(secs=(F.col("i") / F.col("rate")).cast("decimal(18,6)"))
    wide = at.groupBy("station", time.alias("datetime")).pivot("channel", list(form.columns)).agg(F.max("value"))
    return wide.select("station", "datetime", *converted(form))


def list_files(spark: SparkSession, path: str | list[str], pattern: str) -> DataFrame:
    """Files below one or more folders whose names match a glob."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select("path", "modificationTime", "length")
