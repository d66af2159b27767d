"""How the library's entities stand on the driver's tables, in Spark and in SQL.

``events`` are samples: ``user_id`` is the device, ``event_type`` the channel. ``nation`` and
``region`` are stations and networks, each with the components E, N and Z; places and dates
follow from the keys. ``embeddings`` are waveforms of 64 samples at 64 Hz.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwave.session import table

Query = Callable[[SparkSession, str], DataFrame]


class Plans:
    """A module's queries and their SQL twins."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, key: str, sql: str | None = None) -> Callable[[Query], Query]:
        def kept(query: Query) -> Query:
            self.queries[key] = query
            if sql:
                self.oracles[key] = sql
            return query

        return kept


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    stations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    letters = F.posexplode(F.array(*map(F.lit, "ENZ"))).alias("_i", "component")
    k = F.col("n_nationkey")
    return stations.select("*", letters).select(
        (k * 3 + F.col("_i") + 1).cast("long").alias("component_id"), F.col("r_name").alias("network"), F.col("n_name").alias("station"), "component",
        ((k * 37) % 120 - 60).cast("double").alias("lat"), ((k * 53) % 360 - 180).cast("double").alias("lon"),
        F.expr("make_timestamp_ntz(2010 + n_nationkey % 5, 1, 1, 0, 0, 0)").alias("start_date"),
        F.expr("make_timestamp_ntz(2013 + n_nationkey % 5, 1, 1, 0, 0, 0)").alias("end_date"),
    )


COMPONENTS_SQL = """component AS (
  SELECT CAST(n_nationkey * 3 + i AS BIGINT) AS component_id, r_name AS network, n_name AS station, substr('ENZ', i, 1) AS component,
         CAST((n_nationkey * 37) % 120 - 60 AS DOUBLE) AS lat, CAST((n_nationkey * 53) % 360 - 180 AS DOUBLE) AS lon,
         make_timestamp(2010 + n_nationkey % 5, 1, 1, 0, 0, 0.0) AS start_date, make_timestamp(2013 + n_nationkey % 5, 1, 1, 0, 0, 0.0) AS end_date
  FROM nation JOIN region ON n_regionkey = r_regionkey, (SELECT unnest([1, 2, 3]) AS i))"""

PAIRS_SQL = (
    COMPONENTS_SQL
    + """, both_sides AS (
  SELECT a.component_id AS component_id_a, b.component_id AS component_id_b, a.network AS network_a, b.network AS network_b, a.station AS station_a, b.station AS station_b,
         a.component AS component_a, b.component AS component_b, a.component || b.component AS component_code_pair, a.component_id = b.component_id AS autocorrelation,
         a.station = b.station AND a.network = b.network AS one_station, a.lat AS lat_a, a.lon AS lon_a, b.lat AS lat_b, b.lon AS lon_b,
         greatest(a.start_date, b.start_date) AS both_begun, least(a.end_date, b.end_date) AS one_ended
  FROM component a, component b WHERE (a.station = b.station AND a.network = b.network) OR a.lon > b.lon OR (a.lon = b.lon AND a.lat > b.lat)),
angles AS (SELECT *, radians(lat_a) AS fa, radians(lat_b) AS fb, radians(lon_b - lon_a) AS dl FROM both_sides),
pair AS (SELECT *, one_station AND NOT autocorrelation AS intracorrelation,
  CASE WHEN one_station THEN 0.0 ELSE acos(greatest(-1.0, least(1.0, sin(fa) * sin(fb) + cos(fa) * cos(fb) * cos(dl)))) END AS arc,
  CASE WHEN one_station THEN 0.0 ELSE (degrees(atan2(sin(-dl) * cos(fa), cos(fb) * sin(fa) - sin(fb) * cos(fa) * cos(-dl))) + 360.0) % 360.0 END AS azimuth,
  CASE WHEN one_station THEN 0.0 ELSE (degrees(atan2(sin(dl) * cos(fb), cos(fa) * sin(fb) - sin(fa) * cos(fb) * cos(dl))) + 360.0) % 360.0 END AS backazimuth
  FROM angles)"""
)


def period(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The first and last time of the events, as texts."""
    row = table(spark, sf_dir, "events").agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()
    return str(row.first), str(row.last)


def spans_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows from the events' first day to their last, numbered from 2024-01-01."""
    days = table(spark, sf_dir, "events").agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    day = days.select(F.explode(F.sequence("a", "b")).alias("d")).select("d", F.col("d").cast("timestamp_ntz").alias("starttime"))
    number = F.datediff("d", F.lit("2024-01-01").cast("date")).cast("long").alias("timespan_id")
    return day.select(number, "starttime", (F.col("starttime") + F.expr("interval 12 hours")).alias("midtime"), (F.col("starttime") + F.expr("interval 1 day")).alias("endtime"))


SPANS_SQL = """span AS (SELECT date_diff('day', DATE '2024-01-01', CAST(d AS DATE)) AS timespan_id, d AS starttime, d + INTERVAL 12 HOURS AS midtime, d + INTERVAL 1 DAY AS endtime
  FROM (SELECT unnest(generate_series(CAST(min(CAST(ts AS DATE)) AS TIMESTAMP), CAST(max(CAST(ts AS DATE)) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM events))"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the number of their day, which is their window's."""
    events = table(spark, sf_dir, "events").filter(F.col("ts") >= F.lit("2024-01-01").cast("timestamp_ntz"))
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    return events.select("event_id", "ts", "user_id", "event_type", "value", day.alias("timespan_id")).filter("timespan_id < 30")


SAMPLES_SQL = """sample AS (SELECT event_id, ts, user_id, event_type, value, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS timespan_id
  FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31')"""

#: Chunk statistics by central moments; DuckDB's own skewness and kurtosis correct for bias.
CHUNKS_SQL = (
    SAMPLES_SQL
    + """, centred AS (SELECT *, value - avg(value) OVER (PARTITION BY timespan_id, event_type) AS d FROM sample),
chunk AS (SELECT timespan_id, event_type, count(*) AS npts, sum(value * value) / count(*) AS energy, min(value) AS min, max(value) AS max, avg(value) AS mean,
  var_samp(value) AS variance, avg(d * d * d) / pow(avg(d * d), 1.5) AS skewness, avg(d * d * d * d) / pow(avg(d * d), 2) - 3 AS kurtosis
  FROM centred GROUP BY timespan_id, event_type)"""
)


def waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


WAVEFORMS_SQL = "wave AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
