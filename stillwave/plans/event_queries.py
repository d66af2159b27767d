"""Detection and confirmation of events, and chains of equi-joins over their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwave.functions import columns as C
from stillwave.operators import events as E
from stillwave.operators import grid, segments
from stillwave.plans import bindings as B
from stillwave.session import table

PLANS = B.Plans()

_ORDER = ["ts", "event_id"]
_RATIO_SQL = """r AS (SELECT event_type, CAST(ts AS DATE) AS day, event_id, ts, value, CASE WHEN row_number() OVER o >= 10 THEN avg(value * value) OVER (o ROWS 2 PRECEDING) / avg(value * value) OVER (o ROWS 9 PRECEDING) ELSE 0.0 END AS ratio
  FROM events WINDOW o AS (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id))"""
# DuckDB takes no frame on a named window, so the frames are spelled out.
_RATIO_SQL = _RATIO_SQL.replace("OVER (o ROWS 2 PRECEDING)", "OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id ROWS 2 PRECEDING)").replace("OVER (o ROWS 9 PRECEDING)", "OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id ROWS 9 PRECEDING)")
_ACTIVE_SQL = f"""{_RATIO_SQL}, a AS (SELECT *, coalesce(last_value(CASE WHEN ratio > 1.5 THEN true WHEN ratio <= 0.7 THEN false END IGNORE NULLS)
  OVER (PARTITION BY event_type, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS active FROM r)"""
_ISLANDS_SQL = """, n AS (SELECT *, row_number() OVER (PARTITION BY event_type, day ORDER BY ts, event_id) AS rn FROM a), f AS (SELECT *, rn - row_number() OVER (PARTITION BY event_type, day ORDER BY ts, event_id) AS run FROM n WHERE active)
SELECT event_type, day, min(ts) AS start, max(ts) AS stop, count(*) AS npts, round(max(abs(value)), 6) + 0.0 AS peak FROM f GROUP BY event_type, day, run"""


#: A chunk is one day of one channel: as in the reference, detection doesn't look beyond it,
#: which also bounds what one task sorts, however many samples a channel has.
_CHUNK = ["event_type", "day"]


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").alias("day"), "event_id", "ts", "value")


def _ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sta_lta(_samples(spark, sf_dir), _CHUNK, _ORDER, "value", 3, 10)


def _runs(df: DataFrame) -> DataFrame:
    return E.islands(df, _CHUNK, _ORDER, "active", F.min("ts").alias("start"), F.max("ts").alias("stop"), F.count("*").alias("npts"), C.rounded(F.max(F.abs("value"))).alias("peak"))


@PLANS.add("wn8_sta_lta", f"WITH {_RATIO_SQL} SELECT event_id, round(ratio, 6) + 0.0 AS ratio FROM r")
def wn8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ratios(spark, sf_dir).select("event_id", C.rounded(F.col("ratio")).alias("ratio"))


@PLANS.add("wn9_triggers", f"WITH {_ACTIVE_SQL}{_ISLANDS_SQL}")
def wn9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(E.hysteresis(_ratios(spark, sf_dir), _CHUNK, _ORDER, "ratio", 1.5, 0.7))


@PLANS.add("wn9_triggers_across_days", f"""WITH {_RATIO_SQL}, s AS (SELECT event_type, ts, event_id, value, last_value(CASE WHEN ratio > 1.5 THEN true WHEN ratio <= 0.7 THEN false END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS active FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - row_number() OVER (PARTITION BY event_type, coalesce(active, false) ORDER BY ts, event_id) AS k FROM s)
SELECT event_type, min(ts) AS start, max(ts) AS stop, count(*) AS npts, round(max(abs(value)), 6) + 0.0 AS peak FROM n WHERE active GROUP BY event_type, k""")
def wn9_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triggers of each type's whole history, which go on over midnight; days are segments."""
    day = _ratios(spark, sf_dir).withColumn("part", F.to_date("ts"))
    active = segments.hysteresis(day, ["event_type"], "part", _ORDER, "ratio", 1.5, 0.7)
    measures = {"start": ("min", F.col("ts")), "stop": ("max", F.col("ts")), "peak": ("max", F.abs("value"))}
    found = segments.runs(active, ["event_type"], "part", _ORDER, "active", measures)
    return found.select("event_type", "start", "stop", F.col("length").alias("npts"), C.rounded(F.col("peak")).alias("peak"))


@PLANS.add("wn10_spikes", f"""WITH a AS (SELECT event_type, CAST(ts AS DATE) AS day, event_id, ts, value, max(CASE WHEN abs(value) >= 150 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS active FROM events){_ISLANDS_SQL}""")
def wn10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(E.spikes(_samples(spark, sf_dir), _CHUNK, _ORDER, "value", 150.0, 2))


_DETECTION_SQL = "d AS (SELECT event_id AS detection_id, user_id, user_id % 5 AS network, user_id % 25 AS station, ts AS t0, ts + INTERVAL 30 MINUTES AS t1, 1 + user_id % 2 AS weight, value FROM events WHERE value > 100)"


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf_dir, "events").filter("value > 100").select(
        F.col("event_id").alias("detection_id"), "user_id", (u % 5).alias("network"), (u % 25).alias("station"), F.col("ts").alias("t0"),
        (F.col("ts") + F.expr("interval 30 minutes")).alias("t1"), (1 + u % 2).alias("weight"), "value",
    )


@PLANS.add("wn11_event_cut", f"""WITH {_DETECTION_SQL} SELECT detection_id, count(*) AS npts, round(max(abs(e.value)), 6) + 0.0 AS pgv FROM d JOIN events e ON e.user_id = d.user_id
AND e.ts >= t0 - INTERVAL 1 HOUR AND e.ts < t1 + INTERVAL 1 HOUR GROUP BY detection_id""")
def wn11(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _detections(spark, sf_dir).select("detection_id", "user_id", (F.col("t0") - F.expr("interval 1 hour")).alias("s"), (F.col("t1") + F.expr("interval 1 hour")).alias("e"))
    found = grid.bucketed_range_join(_samples(spark, sf_dir), d, "ts", "s", "e", 7200, keys=("user_id",))
    return found.groupBy("detection_id").agg(F.count("*").alias("npts"), C.rounded(F.max(F.abs("value"))).alias("pgv"))


_SLOT_SQL = f"""{_DETECTION_SQL}, slot AS (SELECT CAST(i AS BIGINT) AS slot, TIMESTAMP '2024-01-01' + to_hours(CAST(i AS INTEGER)) AS s, TIMESTAMP '2024-01-01' + to_hours(CAST(i AS INTEGER) + 1) AS e FROM range(720) t(i)),
voted AS (SELECT network, slot, detection_id, weight, station FROM d JOIN slot ON slot.e >= t0 - INTERVAL 10 MINUTES AND slot.s < t1 + INTERVAL 10 MINUTES)"""


def _voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.slots(_detections(spark, sf_dir), "t0", "t1", "2024-01-01", 3600, 600, 720)


@PLANS.add("jn20_vote_grid", f"WITH {_SLOT_SQL} SELECT network, slot, CAST(sum(weight) AS BIGINT) AS votes FROM voted GROUP BY ALL")
def jn20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voted(spark, sf_dir).groupBy("network", "slot").agg(F.sum("weight").alias("votes"))


@PLANS.add(
    "ag9_confirmations",
    f"""WITH {_SLOT_SQL}, c AS (SELECT network, slot, CAST(sum(weight) AS BIGINT) AS votes FROM voted GROUP BY ALL HAVING sum(weight) >= 3),
r AS (SELECT *, slot - row_number() OVER (PARTITION BY network ORDER BY slot) AS run FROM c),
m AS (SELECT r.network, run, list_sort(list(DISTINCT detection_id)) AS detections FROM voted v JOIN r ON v.network = r.network AND v.slot = r.slot GROUP BY ALL),
e AS (SELECT network, run, min(slot) AS first_slot, max(slot) AS last_slot, max(votes) AS votes FROM r GROUP BY ALL)
SELECT network, first_slot, last_slot, votes, detections FROM e JOIN m USING (network, run)""",
)
def ag9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confirmations(_voted(spark, sf_dir), ["network"], "weight", "detection_id", 3)


_NEAR_SQL = f"""{_DETECTION_SQL}, day AS (SELECT *, CAST(t0 AS DATE) AS event_day, abs(epoch_us(t0) - epoch_us(CAST(CAST(t0 AS DATE) AS TIMESTAMP) + INTERVAL 12 HOURS)) AS dt FROM d),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_day, station ORDER BY dt, detection_id) AS k FROM day) WHERE k = 1)"""


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _detections(spark, sf_dir).withColumn("event_day", F.to_date("t0"))
    noon = F.col("event_day").cast("timestamp_ntz") + F.expr("interval 12 hours")
    micros = lambda c: F.unix_micros(c.cast("timestamp_ltz"))
    return E.nearest_detection(d, ["event_day", "station"], F.abs(micros(F.col("t0")) - micros(noon)), "detection_id")


@PLANS.add("ag10_nearest_detection", f"WITH {_NEAR_SQL} SELECT event_day, station, detection_id FROM k")
def ag10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select("event_day", "station", "detection_id")


@PLANS.add("ag11_revote", f"WITH {_NEAR_SQL} SELECT event_day, CAST(sum(weight) AS BIGINT) AS votes, round(max(value), 6) + 0.0 AS pgv, count(DISTINCT station) AS stations FROM k GROUP BY event_day")
def ag11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).groupBy("event_day").agg(F.sum("weight").alias("votes"), C.rounded(F.max("value")).alias("pgv"), F.countDistinct("station").alias("stations"))


@PLANS.add("ldr3_event_bundle", f"""WITH {_DETECTION_SQL} SELECT detection_id, list(e.event_id ORDER BY e.ts, e.event_id) AS samples FROM d JOIN events e ON e.user_id = d.user_id AND e.ts >= t0 AND e.ts <= t1 GROUP BY detection_id""")
def ldr3(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _detections(spark, sf_dir).select("detection_id", "user_id", "t0", "t1")
    found = grid.bucketed_range_join(_samples(spark, sf_dir), d, "ts", "t0", "t1", 3600, closed=True, keys=("user_id",))
    rows = found.groupBy("detection_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("r"))
    return rows.select("detection_id", F.col("r.event_id").alias("samples"))


@PLANS.add("run10_run_header", f"WITH {_DETECTION_SQL} SELECT network, count(*) AS n, list_sort(list(DISTINCT station)) AS stations FROM d GROUP BY network")
def run10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detections(spark, sf_dir).groupBy("network").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("station")).alias("stations"))


@PLANS.add("flt10_results_with_parents", f"WITH {_DETECTION_SQL} SELECT detection_id, n_name, c_mktsegment FROM d JOIN nation ON n_nationkey = station LEFT JOIN customer ON c_custkey = user_id + 1 WHERE network IN (1, 3)")
def flt10(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _detections(spark, sf_dir).filter(F.col("network").isin(1, 3))
    d = d.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("station"))
    return d.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("user_id") + 1, "left").select("detection_id", "n_name", "c_mktsegment")


@PLANS.add("jn10_windows_chunks_qc", f"""WITH {B.SAMPLES_SQL}, {B.SPANS_SQL}, c AS (SELECT timespan_id, event_type, avg(value) AS m, count(*) AS n FROM sample GROUP BY ALL)
SELECT timespan_id, count(*) AS traces, CAST(sum(n) AS BIGINT) AS npts FROM span JOIN c USING (timespan_id) WHERE m BETWEEN 30 AND 70 GROUP BY timespan_id HAVING count(*) >= 2""")
def jn10(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.samples(spark, sf_dir).groupBy("timespan_id", "event_type").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    good = B.spans_of_events(spark, sf_dir).join(c.filter("m between 30 and 70"), "timespan_id")
    return good.groupBy("timespan_id").agg(F.count("*").alias("traces"), F.sum("n").alias("npts")).filter("traces >= 2")


@PLANS.add("jn16_result_peaks", """SELECT l_orderkey, l_linenumber, o_custkey, c_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity >= 45""")
def jn16(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = table(spark, sf_dir, "lineitem").filter("l_quantity >= 45").select("l_orderkey", "l_linenumber")
    results = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    params = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return peaks.join(results, "l_orderkey").join(params, "o_custkey").select("l_orderkey", "l_linenumber", "o_custkey", "c_nationkey")


@PLANS.add("jn17_files_of_results", "SELECT o_orderkey, count(*) AS files FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def jn17(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey").groupBy("o_orderkey").agg(F.count("*").alias("files"))


@PLANS.add("flt13_peaks", "SELECT l_orderkey, n FROM (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 20 GROUP BY l_orderkey) WHERE n >= 4")
def flt13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_quantity > 20").groupBy("l_orderkey").agg(F.count("*").alias("n")).filter("n >= 4")


@PLANS.add("src8_soh_pivot", "SELECT CAST(ts AS DATE) AS day, round(avg(CASE WHEN event_type = 'click' THEN value END), 6) + 0.0 AS click, round(avg(CASE WHEN event_type = 'view' THEN value END), 6) + 0.0 AS view, CAST(NULL AS DOUBLE) AS missing FROM events GROUP BY 1")
def src8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels as columns; one that no row has stays null."""
    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).pivot("event_type", ["click", "view", "missing"]).agg(C.rounded(F.avg("value")))
    return e.select("day", "click", "view", "missing")


@PLANS.add("jn23_last_known_state", """WITH state AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'error' GROUP BY user_id, ts)
SELECT e.event_id, CASE WHEN e.ts - s.ts <= INTERVAL 3 DAYS THEN s.value END AS state, CASE WHEN e.ts - s.ts <= INTERVAL 3 DAYS THEN s.ts END AS known_since
FROM events e ASOF LEFT JOIN state s ON e.user_id = s.user_id AND e.ts >= s.ts""")
def jn23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event its device's last error at or before it, of the last three days."""
    e = table(spark, sf_dir, "events")
    found = grid.as_of(e.select("event_id", "user_id", "ts"), e.filter("event_type = 'error'").select("user_id", "ts", "value"), ["user_id"], "ts", "ts", tolerance_s=3 * 86_400, bucket_s=43_200, carried=16)
    return found.select("event_id", F.col("found.value").alias("state"), F.col("found.ts").alias("known_since"))
