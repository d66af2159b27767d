"""Windows, filters, projections and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwave.functions import columns as C
from stillwave.operators import chunks, grid, signals
from stillwave.plans import bindings as B
from stillwave.session import table

PLANS = B.Plans()


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def grid_sql(step: int, length: int, where: str = "") -> str:
    """The grid over the days of the events, up to the midnight before the last one."""
    return f"""SELECT s AS starttime, s + INTERVAL {length // 2} SECONDS AS midtime, s + INTERVAL {length} SECONDS AS endtime
FROM (SELECT unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)) - INTERVAL 1 MICROSECOND, INTERVAL {step} SECONDS)) AS s FROM events) {where}"""


WITHIN = "WHERE CAST(s AS DATE) = CAST(s + INTERVAL {0} SECONDS - INTERVAL 1 MICROSECOND AS DATE)"


@PLANS.add("wn1_windows", grid_sql(1800, 1800))
def wn1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half hours over the events' whole time; both ends are cut to midnight."""
    return grid.timespans(spark, *B.period(spark, sf_dir), 1800, across_midnight=True)


@PLANS.add("wn2_windows_within_days", grid_sql(1800, 3600, WITHIN.format(3600)))
def wn2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.timespans(spark, *B.period(spark, sf_dir), 3600, overlap_s=1800)


@PLANS.add("wn3_stacking_windows", grid_sql(10800, 21600))
def wn3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.timespans(spark, *B.period(spark, sf_dir), 21600, overlap_s=21600 - grid.window_step(21600, overlap_s=10800), across_midnight=True)


@PLANS.add("flt2_windows_between", f"WITH {B.SPANS_SQL} SELECT * FROM span WHERE starttime >= TIMESTAMP '2024-01-05' AND endtime <= TIMESTAMP '2024-01-20'")
def flt2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.between(B.spans_of_events(spark, sf_dir), ntz("2024-01-05"), ntz("2024-01-20"))


@PLANS.add(
    "flt3_windows_chosen",
    f"""WITH {B.SPANS_SQL} SELECT * FROM span WHERE starttime >= TIMESTAMP '2024-01-03' AND starttime <= TIMESTAMP '2024-01-28'
AND timespan_id NOT IN (5, 9) AND isodow(midtime) IN (1, 2, 3, 4, 5) AND hour(midtime) IN (11, 12)""",
)
def flt3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.choose(B.spans_of_events(spark, sf_dir), ntz("2024-01-03"), ntz("2024-01-28"), rejected=[5, 9], weekdays=[1, 2, 3, 4, 5], hours=[11, 12])


@PLANS.add("flt4_windows_of_day", f"WITH {B.SPANS_SQL} SELECT * FROM span WHERE year(midtime) = 2024 AND dayofyear(midtime) = 17")
def flt4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.of_day(B.spans_of_events(spark, sf_dir), 2024, 17)


@PLANS.add("flt5_counts", f"WITH {B.SAMPLES_SQL} SELECT count(*) AS n FROM (SELECT DISTINCT timespan_id, event_type FROM sample)")
def flt5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.samples(spark, sf_dir).select("timespan_id", "event_type").distinct().agg(F.count("*").alias("n"))


@PLANS.add(
    "flt6_chunks_filtered",
    f"""WITH {B.CHUNKS_SQL} SELECT timespan_id, event_type, npts, round(mean, 6) + 0.0 AS mean FROM chunk
WHERE event_type IN ('click', 'view', 'purchase') AND timespan_id BETWEEN 3 AND 20 AND timespan_id NOT IN (7, 8)""",
)
def flt6(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.col("event_type").isin("click", "view", "purchase") & F.col("timespan_id").between(3, 20) & ~F.col("timespan_id").isin(7, 8)
    found = chunks.statistics(B.samples(spark, sf_dir).filter(wanted), ["timespan_id", "event_type"])
    return found.select("timespan_id", "event_type", "npts", C.rounded(F.col("mean")).alias("mean"))


@PLANS.add(
    "flt7_sibling_channels",
    f"""WITH {B.SAMPLES_SQL}, chunk AS (SELECT timespan_id, user_id, event_type, count(*) AS npts FROM sample GROUP BY ALL)
SELECT a.timespan_id, a.user_id, a.event_type, b.event_type AS other_type, b.npts AS other_npts FROM chunk a JOIN chunk b USING (timespan_id, user_id) WHERE a.event_type <> b.event_type""",
)
def flt7(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.samples(spark, sf_dir).groupBy("timespan_id", "user_id", "event_type").agg(F.count("*").alias("npts"))
    other = c.select("timespan_id", "user_id", F.col("event_type").alias("other_type"), F.col("npts").alias("other_npts"))
    return c.drop("npts").join(other, ["timespan_id", "user_id"]).filter("event_type <> other_type")


@PLANS.add(
    "flt11_one_file_a_day",
    f"""WITH {B.SAMPLES_SQL} SELECT user_id, timespan_id, count(*) AS files, count(*) = 1 AS exactly_one FROM (SELECT DISTINCT user_id, timespan_id, event_type FROM sample) GROUP BY ALL""",
)
def flt11(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = B.samples(spark, sf_dir).select("user_id", "timespan_id", "event_type").distinct()
    return files.groupBy("user_id", "timespan_id").agg(F.count("*").alias("files"), (F.count("*") == 1).alias("exactly_one"))


@PLANS.add(
    "flt12_index_covering",
    f"""WITH {B.SPANS_SQL}, idx AS (SELECT user_id, min(ts) AS first, max(ts) AS last FROM events GROUP BY user_id)
SELECT user_id, timespan_id FROM idx JOIN span ON first <= starttime AND last >= endtime - INTERVAL 1 MICROSECOND""",
)
def flt12(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    spans = B.spans_of_events(spark, sf_dir).withColumn("endtime", F.col("endtime") - F.expr("interval 1 microsecond"))
    return grid.bucketed_containment_join(spans, index, "starttime", "endtime", "first", "last", 86_400).select("user_id", "timespan_id")


@PLANS.add("flt14_overlap", """SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
WHERE a.o_orderdate <= b.o_orderdate + INTERVAL 30 DAYS AND b.o_orderdate <= a.o_orderdate + INTERVAL 30 DAYS""")
def flt14(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("s"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("e"))
    near = grid.overlapping_pairs(o, ["o_custkey"], "s", "e", 30 * 86_400).filter("o_orderkeya < o_orderkeyb")
    return near.select(F.col("o_orderkeya").alias("a"), F.col("o_orderkeyb").alias("b"))


@PLANS.add("flt15_null_safe", """SELECT event_id, CASE WHEN v IS NULL OR isnan(v) THEN true ELSE v >= 20.0 END AS ok FROM
(SELECT event_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN CAST('NaN' AS DOUBLE) ELSE value END AS v FROM events)""")
def flt15(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 7
    v = F.when(k == 0, F.lit(None)).when(k == 1, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", C.compare_null_safe(v, F.lit(20.0), ">=", True).alias("ok"))


@PLANS.add("flt16_latest", "SELECT max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events")
def flt16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))


@PLANS.add("flt17_same_day", """SELECT event_id, CAST(ts AS DATE) = CAST(ts + to_hours(CAST(event_id % 30 AS INTEGER)) - INTERVAL 1 MICROSECOND AS DATE) AS one_day FROM events""")
def flt17(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.col("ts") + F.expr("make_dt_interval(0, CAST(event_id % 30 AS INT))")
    return table(spark, sf_dir, "events").select("event_id", C.same_day(F.col("ts"), end).alias("one_day"))


@PLANS.add("prj1_date_parts", """SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour,
CAST(dayofyear(ts) AS INTEGER) AS doy, CAST(isodow(ts) AS INTEGER) AS isoweekday FROM events""")
def prj1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", *(c.alias(n) for n, c in C.date_parts(F.col("ts")).items()))


@PLANS.add("prj2_component_letter", "SELECT DISTINCT event_type, right(event_type, 1) AS component FROM events")
def prj2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", C.component_letter(F.col("event_type")).alias("component")).distinct()


@PLANS.add("prj3_central_frequency", "SELECT p_partkey, (p_size + p_size * 1.5) / 2 AS central_freq FROM part")
def prj3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_size") + F.col("p_size") * F.lit(1.5)) / 2).alias("central_freq"))


@PLANS.add("prj4_soh_units", "SELECT event_id, ts AS datetime, value / 1000 AS supply_voltage, user_id / 1000 AS temperature FROM events")
def prj4(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").alias("datetime"), (F.col("value") / 1000).alias("supply_voltage"), (F.col("user_id") / 1000).alias("temperature"))


@PLANS.add("prj5_current_sum", """SELECT c_custkey, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / 1000, 6) + 0.0 AS total_current
FROM (SELECT c_custkey, c_acctbal AS a, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal * 2 END AS b, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal / 2 END AS c FROM customer)""")
def prj5(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, x = F.col("c_custkey"), F.col("c_acctbal")
    parts = [x, F.when(k % 3 != 0, x * 2), F.when(k % 5 != 0, x / 2)]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    return table(spark, sf_dir, "customer").select("c_custkey", C.rounded(total / 1000).alias("total_current"))


@PLANS.add("prj8_availability", f"""WITH {B.SAMPLES_SQL} SELECT event_type, round_even(count(DISTINCT timespan_id) * 100.0 / 30, 2) AS percentage FROM sample GROUP BY event_type""")
def prj8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stillwave.operators.inventory import availability

    return availability(B.samples(spark, sf_dir).select("timespan_id", "event_type").distinct(), 30, "event_type")


@PLANS.add("or3_top_k", """SELECT label, vec_id, CAST(k AS INTEGER) AS rank, round(amplitude, 6) + 0.0 AS amplitude FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY amplitude DESC, vec_id) AS k
FROM (SELECT label, vec_id, list_max(CAST(embedding AS DOUBLE[])) AS amplitude FROM embeddings)) WHERE k <= 5""")
def or3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    best = Window.partitionBy("label").orderBy(F.desc("amplitude"), "vec_id")
    peaks = B.waveforms(spark, sf_dir).select("label", "vec_id", F.array_max("x").alias("amplitude"))
    return peaks.withColumn("rank", F.row_number().over(best)).filter("rank <= 5").select("label", "vec_id", "rank", C.rounded(F.col("amplitude")).alias("amplitude"))


@PLANS.add("or4_ratio_cutoff", """SELECT label, vec_id, round(misfit, 6) + 0.0 AS misfit FROM (SELECT *, min(misfit) OVER (PARTITION BY label) AS least
FROM (SELECT label, vec_id, list_max(CAST(embedding AS DOUBLE[])) AS misfit FROM embeddings)) WHERE misfit < 1.5 * least""")
def or4(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = B.waveforms(spark, sf_dir).select("label", "vec_id", F.array_max("x").alias("misfit"))
    least = w.groupBy("label").agg(F.min("misfit").alias("least"))
    return w.join(least, "label").filter("misfit < 1.5D * least").select("label", "vec_id", C.rounded(F.col("misfit")).alias("misfit"))


@PLANS.add("st1_union", """SELECT source, count(*) AS n FROM (SELECT 'customer' AS source, c_nationkey AS k FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier) GROUP BY source""")
def st1(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.lit("customer").alias("source"), F.col("c_nationkey").alias("k"))
    b = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("source"), F.col("s_nationkey").alias("k"))
    return a.unionByName(b).groupBy("source").agg(F.count("*").alias("n"))


@PLANS.add("st2_set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def st2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))).distinct()


@PLANS.add("sc5_slowness", """SELECT vec_id, round(sqrt(x * x + y * y), 6) + 0.0 AS slowness, round(degrees(atan2(x, y)), 6) + 0.0 AS azimuth,
round(180.0 - ((-degrees(atan2(x, y)) % 360.0) + 360.0) % 360.0, 6) + 0.0 AS backazimuth FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)""")
def sc5(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.element_at("x", 1), F.element_at("x", 2)
    return B.waveforms(spark, sf_dir).select("vec_id", C.rounded(C.slowness(x, y)).alias("slowness"), C.rounded(C.azimuth(x, y)).alias("azimuth"), C.rounded(C.backazimuth(x, y)).alias("backazimuth"))


@PLANS.add("sc6_velocity", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 1.0 / (p_size % 5) END AS velocity FROM part")
def sc6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.try_divide(F.lit(1.0), (F.col("p_size") % 5).cast("double")).alias("velocity"))


@PLANS.add("sc7_sample_counts", """SELECT p_partkey, CAST(trunc(p_size * 24.0) AS INTEGER) AS expected, CAST(trunc(p_size * 24.0 * 0.98) AS INTEGER) AS least, CAST(trunc(p_size * 24.0 * 1.02) AS INTEGER) AS most FROM part""")
def sc7(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size") * F.lit(24.0)
    return table(spark, sf_dir, "part").select("p_partkey", n.cast("int").alias("expected"), (n * 0.98).cast("int").alias("least"), (n * 1.02).cast("int").alias("most"))


@PLANS.add("sc8_next_power", "SELECT p_partkey, CAST(ceil(log2(p_size)) AS INTEGER) AS exponent FROM part")
def sc8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", C.next_power_exponent(F.col("p_size")).alias("exponent"))


@PLANS.add("sc9_lags", f"WITH {B.WAVEFORMS_SQL} SELECT vec_id, l AS i, round(l / 64.0, 6) + 0.0 AS lag, round(list_inner_product(list_slice(x, greatest(l, 0) + 1, 64 + least(l, 0)), list_slice(x, greatest(-l, 0) + 1, 64 - greatest(l, 0))), 6) + 0.0 AS value FROM wave, (SELECT CAST(unnest(range(-10, 11)) AS INTEGER) AS l)")
def sc9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every waveform's correlation with itself at the lags of its axis."""
    w = B.waveforms(spark, sf_dir).withColumn("same", F.col("x"))
    found = signals.correlations(w, ["vec_id"], "x", "same", 10, normalise=False, demean=False)
    lags = found.select("vec_id", F.posexplode(F.arrays_zip(C.lags(10, 64.0).alias("lag"), F.col("y").alias("value"))).alias("i", "p"))
    return lags.select("vec_id", (F.col("i") - 10).alias("i"), C.rounded(F.col("p.lag")).alias("lag"), C.rounded(F.col("p.value")).alias("value"))


@PLANS.add("sc12_station_params", """SELECT s_suppkey, string_split_regex(s_name || '-' || s_nationkey || ':7', '[-:#\\s]+') AS parts FROM supplier""")
def sc12(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("s_name", F.lit("-"), F.col("s_nationkey").cast("string"), F.lit(":7"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.split(text, r"[-:#\s]+").alias("parts"))


@PLANS.add("sc14_offsets_km", f"""WITH {B.COMPONENTS_SQL} SELECT component_id, round(radians(lon - mlon) * 6371.0 * cos(radians(mlat)), 6) + 0.0 AS x_km, round(radians(lat - mlat) * 6371.0, 6) + 0.0 AS y_km
FROM (SELECT *, avg(lat) OVER (PARTITION BY network) AS mlat, avg(lon) OVER (PARTITION BY network) AS mlon FROM component)""")
def sc14(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    net = Window.partitionBy("network")
    c = B.components(spark, sf_dir).withColumn("mlat", F.avg("lat").over(net)).withColumn("mlon", F.avg("lon").over(net))
    x = F.radians(F.col("lon") - F.col("mlon")) * C.EARTH_KM * F.cos(F.radians("mlat"))
    return c.select("component_id", C.rounded(x).alias("x_km"), C.rounded(F.radians(F.col("lat") - F.col("mlat")) * C.EARTH_KM).alias("y_km"))


@PLANS.add("sc15_decibel", "SELECT o_orderkey, round(10 * log10(o_totalprice), 6) + 0.0 AS db FROM orders")
def sc15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", C.rounded(C.decibel(F.col("o_totalprice"))).alias("db"))
