"""Statistics, verdicts, state of health, incremental filters and upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwave import config
from stillwave.functions import columns as C
from stillwave.operators import chunks as K
from stillwave.operators import grid, segments, snapshots
from stillwave.plans import bindings as B
from stillwave.plans.window_queries import ntz
from stillwave.session import scratch, table

PLANS = B.Plans()

#: Bounds of the fixed quality configuration.
BOUNDS: dict[str, float | None] = {
    "energy_min": 100.0, "energy_max": 9000.0, "min_min": 0.0, "min_max": 5.0, "max_min": 100.0, "max_max": 400.0, "mean_min": 30.0, "mean_max": 70.0,
    "variance_min": 500.0, "variance_max": 6000.0, "skewness_min": 0.5, "skewness_max": 4.0, "kurtosis_min": None, "kurtosis_max": 20.0,
}
GPS_BOUNDS = {"error_min": 1.0, "error_max": 90.0, "uncertainty_min": 0.0, "uncertainty_max": 140.0}
START, END = "2024-01-02", "2024-01-29"
REJECTED = [("click", "2024-01-05 06:00:00", "2024-01-06 00:00:00"), ("error", "2024-01-11 00:00:00", "2024-01-13 12:00:00")]
POLICY = True


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with statistics."""
    return K.statistics(B.samples(spark, sf_dir), ["timespan_id", "event_type"])


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.samples(spark, sf_dir).groupBy("timespan_id", "event_type").agg(F.count("*").alias("samples"))
    spans = F.broadcast(B.spans_of_events(spark, sf_dir))
    return found.join(spans, "timespan_id").withColumn("chunk_id", F.concat_ws("/", "timespan_id", "event_type"))


def _gps(spark: SparkSession, sf_dir: str, when: str = "true") -> DataFrame:
    """Mean GPS error and uncertainty by window and channel."""
    e = B.samples(spark, sf_dir).filter(when)
    return e.groupBy("timespan_id", "event_type").agg(F.avg("value").alias("error"), F.avg(F.col("value") * 2 + F.col("user_id") % 10).alias("uncertainty"))


#: The means of receivers that were off for two days, where a join is to meet windows without any.
_ON = "ts < timestamp_ntz'2024-01-10' or ts >= timestamp_ntz'2024-01-12'"
_MEANS_SQL = "SELECT timespan_id, event_type, avg(value) AS error, avg(value * 2 + user_id % 10) AS uncertainty FROM sample"
_ALL_GPS_SQL = f"gps AS ({_MEANS_SQL} GROUP BY timespan_id, event_type)"
_GPS_SQL = f"""gps AS ({_MEANS_SQL}
  WHERE ts < TIMESTAMP '2024-01-10' OR ts >= TIMESTAMP '2024-01-12' GROUP BY timespan_id, event_type)"""


def _bound_sql(bounds: dict[str, float | None]) -> str:
    out = []
    for name, bound in bounds.items():
        metric, side = name.rsplit("_", 1)
        test = f"{metric} {'>=' if side == 'min' else '<='} {bound}"
        out.append(f"{'true' if bound is None else f'CASE WHEN {metric} IS NULL OR isnan({metric}) THEN true ELSE {test} END'} AS ok_{name}")
    return ", ".join(out)


_REJECTED_SQL = ", ".join(f"('{c}', TIMESTAMP '{s}', TIMESTAMP '{e}')" for c, s, e in REJECTED)
_NAMES = ["ok_starttime", "ok_endtime", "ok_accepted_time", *(f"ok_{b}" for b in BOUNDS), *(f"ok_{b}" for b in GPS_BOUNDS)]
_QCONE_SQL = f"""{B.CHUNKS_SQL}, {B.SPANS_SQL}, {_GPS_SQL}, rejected(event_type, s, e) AS (VALUES {_REJECTED_SQL}),
verdict AS (SELECT c.timespan_id, c.event_type, TIMESTAMP '{START}' <= starttime AS ok_starttime, TIMESTAMP '{END}' >= endtime AS ok_endtime,
  NOT EXISTS (SELECT 1 FROM rejected r WHERE r.event_type = c.event_type AND starttime <= r.e AND r.s <= endtime) AS ok_accepted_time, {_bound_sql(BOUNDS)}, {_bound_sql(GPS_BOUNDS)}
  FROM chunk c JOIN span USING (timespan_id) LEFT JOIN (SELECT timespan_id, event_type, {", ".join(K.METRICS)} FROM chunk) s USING (timespan_id, event_type)
  LEFT JOIN gps USING (timespan_id, event_type))"""
# The chunk's own columns would hide the joined ones, so the left side gives only its key.
_QCONE_SQL = _QCONE_SQL.replace("FROM chunk c JOIN span", "FROM (SELECT timespan_id, event_type FROM chunk) c JOIN span")
_PASSING_SQL = " AND ".join(_NAMES)


def qcone(spark: SparkSession, sf_dir: str, strict_gps: bool = False, inverted: bool = False) -> DataFrame:
    """21 verdicts for every chunk: one plan of left joins and expressions."""
    periods = spark.createDataFrame(REJECTED, "event_type string, starttime string, endtime string")
    periods = periods.select("event_type", F.col("starttime").cast("timestamp_ntz").alias("starttime"), F.col("endtime").cast("timestamp_ntz").alias("endtime"))
    key = ["timespan_id", "event_type"]
    work = _chunks(spark, sf_dir).join(_stats(spark, sf_dir), key, "left")
    work = K.outside_rejected(K.with_gps(work, _gps(spark, sf_dir, _ON), key, strict_gps), periods, "event_type")
    verdicts = [*K.time_verdicts(ntz(START), ntz(END)), F.col("ok_accepted_time"), *K.bounds_verdicts(BOUNDS, POLICY, inverted), *K.bounds_verdicts(GPS_BOUNDS, POLICY)]
    return work.select(*key, *verdicts)


@PLANS.add("qcv1_qcone", f"WITH {_QCONE_SQL} SELECT *, {_PASSING_SQL} AS is_passing FROM verdict")
def qcv1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qcone(spark, sf_dir).select("*", K.passing(_NAMES))


@PLANS.add("qcv2_time_bounds", f"WITH {B.SPANS_SQL} SELECT timespan_id, TIMESTAMP '{START}' <= starttime AS ok_starttime, TIMESTAMP '{END}' >= endtime AS ok_endtime FROM span")
def qcv2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.spans_of_events(spark, sf_dir).select("timespan_id", *K.time_verdicts(ntz(START), ntz(END)))


@PLANS.add("qcv3_stats_bounds", f"WITH {B.CHUNKS_SQL} SELECT timespan_id, event_type, {_bound_sql(BOUNDS)} FROM chunk")
def qcv3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.statistics(B.samples(spark, sf_dir), ["timespan_id", "event_type"])
    return found.select("timespan_id", "event_type", *K.bounds_verdicts(BOUNDS, POLICY))


@PLANS.add("qcv4_gps_bounds", f"WITH {B.SAMPLES_SQL}, {_ALL_GPS_SQL} SELECT timespan_id, event_type, {_bound_sql(GPS_BOUNDS)} FROM gps")
def qcv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gps(spark, sf_dir).select("timespan_id", "event_type", *K.bounds_verdicts(GPS_BOUNDS, POLICY))


@PLANS.add("qcv6_uses", "SELECT s_suppkey, s_nationkey % 3 = 0 AS uses_gps, s_acctbal > 0 AS uses_stats, s_suppkey % 2 = 0 AS null_value FROM supplier")
def qcv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the configuration of each supplier uses: its bounds follow from the row, null ones aren't used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key, nation, balance in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q = config.QCOneConfig(starttime=START, endtime=END, null_treatment_policy="fail" if key % 2 else "pass", avg_gps_time_error_max=1.0 if nation % 3 == 0 else None, signal_energy_max=balance if balance > 0 else None)
                found.append((key, q.uses_gps, q.uses_stats, q.null_value))
            kinds = (pa.int64(), pa.bool_(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], ["s_suppkey", "uses_gps", "uses_stats", "null_value"])

    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal").mapInArrow(run, "s_suppkey long, uses_gps boolean, uses_stats boolean, null_value boolean")


@PLANS.add("qcv7_chunks_without_qcone", f"WITH {B.SAMPLES_SQL}, c AS (SELECT DISTINCT timespan_id, event_type FROM sample) SELECT * FROM c WHERE NOT (timespan_id < 10 AND event_type IN ('view', 'click'))")
def qcv7(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = B.samples(spark, sf_dir).select("timespan_id", "event_type").distinct()
    done = work.filter("timespan_id < 10 and event_type in ('view', 'click')")
    return K.not_done(work, done, ["timespan_id", "event_type"])


@PLANS.add("prj6_is_passing", f"WITH {_QCONE_SQL} SELECT {_PASSING_SQL} AS is_passing, count(*) AS n FROM verdict GROUP BY 1")
def prj6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qcone(spark, sf_dir).select(K.passing(_NAMES)).groupBy("is_passing").agg(F.count("*").alias("n"))


@PLANS.add("ag1_chunk_statistics", f"WITH {B.CHUNKS_SQL} SELECT timespan_id, event_type, npts, {', '.join(f'round({m}, 6) + 0.0 AS {m}' for m in K.METRICS)} FROM chunk")
def ag1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.statistics(B.samples(spark, sf_dir), ["timespan_id", "event_type"])
    return found.select("timespan_id", "event_type", "npts", *(C.rounded(F.col(m)).alias(m) for m in K.METRICS))


_JOINED = "timespan_id, event_type, npts, round(mean, 6) + 0.0 AS mean, round(error, 6) + 0.0 AS error"


@PLANS.add("jn4_chunks_gps_stats", f"WITH {B.CHUNKS_SQL}, {_ALL_GPS_SQL} SELECT {_JOINED} FROM chunk JOIN gps USING (timespan_id, event_type)")
def jn4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(spark, sf_dir, _gps(spark, sf_dir), True)


@PLANS.add("jn5_top_up", f"WITH {B.CHUNKS_SQL}, {_GPS_SQL} SELECT {_JOINED} FROM chunk LEFT JOIN gps USING (timespan_id, event_type)")
def jn5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(spark, sf_dir, _gps(spark, sf_dir, _ON), False)


def _joined(spark: SparkSession, sf_dir: str, gps: DataFrame, strict: bool) -> DataFrame:
    key = ["timespan_id", "event_type"]
    found = K.with_gps(K.statistics(B.samples(spark, sf_dir), key), gps, key, strict)
    return found.select(*key, "npts", C.rounded(F.col("mean")).alias("mean"), C.rounded(F.col("error")).alias("error"))


@PLANS.add(
    "jn11_soh_in_windows",
    """WITH w AS (SELECT s AS starttime, s + INTERVAL 6 HOURS AS endtime FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 18:00:00', INTERVAL 6 HOURS)) AS s))
SELECT starttime, user_id % 10 AS z_component, count(*) AS n, round(avg(value), 6) + 0.0 AS error FROM events JOIN w ON ts >= starttime AND ts <= endtime GROUP BY ALL""",
)
def jn11(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = grid.timespans(spark, "2024-01-01", "2024-01-31", 21600)
    e = table(spark, sf_dir, "events").select("ts", (F.col("user_id") % 10).alias("z_component"), "value")
    found = grid.bucketed_range_join(e, w, "ts", "starttime", "endtime", 21600, closed=True)
    return found.groupBy("starttime", "z_component").agg(F.count("*").alias("n"), C.rounded(F.avg("value")).alias("error"))


@PLANS.add("ag2_mean_gps", f"""WITH {B.SAMPLES_SQL} SELECT timespan_id, user_id % 10 AS z_component, round(avg(value), 6) + 0.0 AS error, round(avg(value * 2), 6) + 0.0 AS uncertainty, list_sort(list(DISTINCT user_id)) AS devices
FROM sample GROUP BY ALL""")
def ag2(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = B.samples(spark, sf_dir).withColumn("z_component", F.col("user_id") % 10).groupBy("timespan_id", "z_component")
    return by.agg(C.rounded(F.avg("value")).alias("error"), C.rounded(F.avg(F.col("value") * 2)).alias("uncertainty"), F.array_sort(F.collect_set("user_id")).alias("devices"))


_STATIC = "SELECT DISTINCT timespan_id, user_id FROM sample"


@PLANS.add("jn12_rejected_periods", f"""WITH {B.SAMPLES_SQL}, {B.SPANS_SQL}, rejected(event_type, s, e) AS (VALUES {_REJECTED_SQL}), c AS (SELECT DISTINCT timespan_id, event_type FROM sample)
SELECT timespan_id, event_type, NOT EXISTS (SELECT 1 FROM rejected r WHERE r.event_type = c.event_type AND starttime <= r.e AND r.s <= endtime) AS ok_accepted_time FROM c JOIN span USING (timespan_id)""")
def jn12(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = spark.createDataFrame(REJECTED, "event_type string, starttime string, endtime string")
    periods = periods.select("event_type", F.col("starttime").cast("timestamp_ntz").alias("starttime"), F.col("endtime").cast("timestamp_ntz").alias("endtime"))
    return K.outside_rejected(_chunks(spark, sf_dir), periods, "event_type").select("timespan_id", "event_type", "ok_accepted_time")


@PLANS.add("jn13_without_stats", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 10)")
def jn13(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").filter("l_quantity > 10").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@PLANS.add("jn14_skip_existing", f"WITH {B.SAMPLES_SQL}, w AS ({_STATIC}) SELECT * FROM w WHERE (timespan_id, user_id) NOT IN (SELECT (timespan_id, user_id) FROM sample WHERE event_type = 'view')")
def jn14(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.samples(spark, sf_dir)
    return K.not_done(s.select("timespan_id", "user_id").distinct(), s.filter("event_type = 'view'"), ["timespan_id", "user_id"])


@PLANS.add("jn15_passing_only", f"WITH {_QCONE_SQL} SELECT timespan_id, event_type, npts FROM chunk SEMI JOIN (SELECT timespan_id, event_type FROM verdict WHERE {_PASSING_SQL}) v USING (timespan_id, event_type)")
def jn15(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["timespan_id", "event_type"]
    work = K.statistics(B.samples(spark, sf_dir), key).select(*key, "npts")
    return K.passed_only(work, qcv1(spark, sf_dir), key)


_OLD, _NEW = "SELECT s_suppkey AS k, s_acctbal AS v FROM supplier", "SELECT c_custkey AS k, c_acctbal AS v FROM customer"


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as the table that stands, customers as the rows that come; some keys are in both."""
    return (
        table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v")),
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")),
    )


@PLANS.add("snk5_upsert", f"WITH old AS ({_OLD}), new AS ({_NEW}) SELECT * FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT * FROM new")
def snk5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.upsert(*_tables(spark, sf_dir), ["k"])


@PLANS.add("snk6_insert_missing", f"WITH old AS ({_OLD}), new AS ({_NEW}) SELECT * FROM old UNION ALL SELECT * FROM new WHERE k NOT IN (SELECT k FROM old)")
def snk6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.upsert(*_tables(spark, sf_dir), ["k"], nothing_on_conflict=True)


@PLANS.add("run3_committed_upserts", f"WITH old AS ({_OLD}), new AS ({_NEW}) SELECT * FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT * FROM new")
def run3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as committed snapshots: one version with the table that stands, one with the rest."""
    old, new = _tables(spark, sf_dir)
    kept = snapshots.Snapshots.create(spark, scratch(spark, "upserts"), old.schema, ["k"], buckets=4)
    kept.upsert(old)
    kept.upsert(new)
    return kept.read()


@PLANS.add("snk8_soh_bridge", f"WITH {B.COMPONENTS_SQL} SELECT DISTINCT event_id, component_id FROM events JOIN component ON component_id % 25 = user_id % 25")
def snk8(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.components(spark, sf_dir).select("component_id", (F.col("component_id") % 25).alias("device"))
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 25).alias("device")).join(c, "device").select("event_id", "component_id").dropDuplicates()


@PLANS.add("snk9_next_id", "SELECT CAST(coalesce(max(event_id) + 1, 1) AS BIGINT) AS next_id FROM events")
def snk9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.next_id(table(spark, sf_dir, "events"), "event_id")


@PLANS.add(
    "ag13_run_lengths",
    """WITH f AS (SELECT user_id, event_id, value > 30 AS flag, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
g AS (SELECT *, rn - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM f WHERE flag)
SELECT user_id, count(*) AS length, min(event_id) AS first, max(event_id) AS last FROM g GROUP BY user_id, k""",
)
def ag13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each device's events, by segments of event ids."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") > 30).alias("flag"), F.floor(F.col("event_id") / 4096).alias("part"))
    ends = {"first": ("min", F.col("event_id")), "last": ("max", F.col("event_id"))}
    return segments.runs(e, ["user_id"], "part", ["event_id"], "flag", ends)


@PLANS.add("ag12_mode", "SELECT user_id, min(h) AS hour FROM (SELECT user_id, h, n, max(n) OVER (PARTITION BY user_id) AS m FROM (SELECT user_id, hour(ts) AS h, count(*) AS n FROM events GROUP BY ALL)) WHERE n = m GROUP BY user_id")
def ag12(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "events").groupBy("user_id", F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))
    return counted.groupBy("user_id").agg(F.max_by("hour", F.struct("n", -F.col("hour"))).alias("hour"))


@PLANS.add("run8_minimum_duration", f"WITH {B.SPANS_SQL} SELECT epoch(max(endtime) - min(starttime)) >= 2 * avg(epoch(endtime - starttime)) AS long_enough FROM span")
def run8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.long_enough(B.spans_of_events(spark, sf_dir))


@PLANS.add("ldr4_sample_bounds", f"WITH {B.SPANS_SQL} SELECT timespan_id, endtime - INTERVAL 1 MICROSECOND AS last_instant, endtime - INTERVAL 40 MILLISECONDS AS last_sample FROM span")
def ldr4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.sample_bounds(B.spans_of_events(spark, sf_dir), 25.0).select("timespan_id", "last_instant", "last_sample")


@PLANS.add("or1_ordered_rows", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events")
def or1(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.to_date("ts").alias("day"))
    return K.numbered(e, ["user_id"], "day", ["ts", "event_id"], "place").select("user_id", "event_id", "place")
