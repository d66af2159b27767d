"""StationXML inventories and exports of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CHANNEL = "struct<_code: string, _startDate: string, _endDate: string, Latitude: string, Longitude: string, Elevation: string>"
_STATION = f"struct<_code: string, _startDate: string, _endDate: string, Latitude: double, Longitude: double, Elevation: double, Channel: array<{_CHANNEL}>>"


def read_stationxml(spark: SparkSession, path: str) -> DataFrame:
    """One row for each station and component letter: ``network``, ``station``,
    ``component``, ``lat``, ``lon``, ``elevation``, ``start_date``, ``end_date``.

    A component's dates are its channels' first and last, else the station's; without an
    end it is taken to stand for ten years. Its place is that of its first epoch.
    """
    raw = spark.read.format("xml").option("rowTag", "Network").schema(f"_code string, Station array<{_STATION}>").load(path)
    stations = raw.select(F.col("_code").alias("network"), F.explode("Station").alias("s"))
    channels = stations.select("network", "s", F.explode("s.Channel").alias("c"))
    time = lambda c: F.to_timestamp_ntz(F.substring(F.col(c), 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    found = channels.groupBy("network", F.col("s._code").alias("station"), F.right("c._code", F.lit(1)).alias("component")).agg(
        F.min(F.struct(time("s._startDate"), "s.Latitude", "s.Longitude", "s.Elevation")).alias("place"),
        F.min(time("c._startDate")).alias("cs"), F.max(time("c._endDate")).alias("ce"), F.min(time("s._startDate")).alias("ss"), F.max(time("s._endDate")).alias("se"),
    )
    start = F.coalesce("cs", "ss")
    return found.select("network", "station", "component", F.col("place.Latitude").alias("lat"), F.col("place.Longitude").alias("lon"), F.col("place.Elevation").alias("elevation"), start.alias("start_date"), F.coalesce("ce", "se", start + F.expr("interval 10 years")).alias("end_date"))


_ROOT = "array<struct<_number: int, Real: struct<_VALUE: double, _plusError: string, _minusError: string>, Imaginary: struct<_VALUE: double, _plusError: string, _minusError: string>>>"
_UNITS = "InputUnits: struct<Name: string>"
_NUMBERS = "array<struct<_VALUE: double, _i: int, _number: int>>"
_STAGE = (
    f"struct<_number: int, PolesZeros: struct<{_UNITS}, PzTransferFunctionType: string, NormalizationFactor: double, Zero: {_ROOT}, Pole: {_ROOT}>, "
    f"Coefficients: struct<{_UNITS}, CfTransferFunctionType: string, Numerator: {_NUMBERS}, Denominator: {_NUMBERS}>, FIR: struct<{_UNITS}, Symmetry: string, NumeratorCoefficient: {_NUMBERS}>, "
    "Decimation: struct<InputSampleRate: struct<_VALUE: double, _unit: string>, Correction: struct<_VALUE: double, _unit: string>>, StageGain: struct<Value: double>>"
)
_EPOCH = f"struct<_code: string, _locationCode: string, _startDate: string, _endDate: string, SampleRate: struct<_VALUE: double, _unit: string>, Response: struct<InstrumentSensitivity: struct<Value: double, {_UNITS}>, Stage: array<{_STAGE}>>>"


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """One row for each channel and epoch: ``network``, ``station``, ``location``, ``channel``,
    ``start_date``, ``end_date`` (null: still open), ``sensitivity``, ``unit`` of the motion, and
    ``stages`` in their order, each as :func:`stillwave.functions.dsp.stage_response` takes it.
    A channel without a response has no stages and no sensitivity."""
    raw = spark.read.format("xml").option("rowTag", "Network").schema(f"_code string, Station array<struct<_code: string, Channel: array<{_EPOCH}>>>").load(path)
    c = raw.select(F.col("_code").alias("network"), F.explode("Station").alias("s")).select("network", F.col("s._code").alias("station"), F.explode("s.Channel").alias("c"))
    time = lambda c: F.to_timestamp_ntz(F.substring(F.col(c), 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    pairs = lambda roots: F.transform(roots, lambda z: F.array(z["Real"]["_VALUE"], z["Imaginary"]["_VALUE"]))
    numbers = lambda column: F.transform(column, lambda v: v["_VALUE"])

    def stage(s):
        pz, cf, fir = s["PolesZeros"], s["Coefficients"], s["FIR"]
        kind = F.when(pz.isNotNull(), "poles_zeros").when(cf.isNotNull(), "coefficients").when(fir.isNotNull(), "fir")
        named = F.upper(F.coalesce(pz["PzTransferFunctionType"], cf["CfTransferFunctionType"], F.lit("DIGITAL")))
        domain = F.when(named.contains("RADIANS"), "RADIANS").when(named.contains("HERTZ"), "HERTZ").otherwise("DIGITAL")
        return F.struct(
            s["_number"].alias("number"), kind.alias("kind"), domain.alias("domain"), pz["NormalizationFactor"].alias("factor"), pairs(pz["Zero"]).alias("zeros"), pairs(pz["Pole"]).alias("poles"),
            F.coalesce(numbers(cf["Numerator"]), numbers(fir["NumeratorCoefficient"])).alias("numerator"), numbers(cf["Denominator"]).alias("denominator"), F.upper(fir["Symmetry"]).alias("symmetry"),
            s["Decimation"]["InputSampleRate"]["_VALUE"].alias("rate"), s["Decimation"]["Correction"]["_VALUE"].alias("correction"), s["StageGain"]["Value"].alias("gain"),
        )

    response, ordered = F.col("c.Response"), F.array_sort("c.Response.Stage", lambda a, b: a["_number"] - b["_number"])
    first = F.get(ordered, F.lit(0))
    unit = F.coalesce(response["InstrumentSensitivity"]["InputUnits"]["Name"], *(first[k]["InputUnits"]["Name"] for k in ("PolesZeros", "Coefficients", "FIR")))
    return c.select(
        "network", "station", F.coalesce("c._locationCode", F.lit("")).alias("location"), F.col("c._code").alias("channel"), time("c._startDate").alias("start_date"), time("c._endDate").alias("end_date"),
        response["InstrumentSensitivity"]["Value"].alias("sensitivity"), unit.alias("unit"), F.transform(ordered, stage).alias("stages"),
    )


def result_path(kind: Column, network: Column, station: Column, component: Column, time: Column) -> Column:
    """The name of a result's file below the folder of its kind, year and component; blanks in
    codes are underscores."""
    plain = lambda c: F.replace(c, F.lit(" "), F.lit("_"))
    code = [plain(network), plain(station), plain(component)]
    return F.concat_ws("/", kind, F.date_format(time, "yyyy"), *code, F.concat_ws(".", *code, kind, F.date_format(time, "yyyy.DDD.HHmm")))


def export_by_pair(ccfs: DataFrame, path: str, pair: list[str], time: str, overwrite: bool = False) -> None:
    """Results by pair, each folder's rows in order of time; an existing export is only
    replaced if asked."""
    ccfs.repartition(*pair).sortWithinPartitions(*pair, time).write.partitionBy(*pair).mode("overwrite" if overwrite else "errorifexists").parquet(path)


def export_gps_csv(soh: DataFrame, path: str, overwrite: bool = False) -> None:
    """Station, time, error and uncertainty as CSV with a header."""
    columns = ["station", "datetime", "time_error", "time_uncertainty"]
    soh.select(*columns).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def write_by_day(chunks: DataFrame, path: str, time: str, *keys: str) -> None:
    """Chunks under year, day of year and the given keys, so that later reads prune. Folders
    that the new chunks fall in are replaced; all others stay."""
    dated = chunks.withColumn("year", F.year(time)).withColumn("doy", F.dayofyear(time))
    dated.write.partitionBy("year", "doy", *keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
