"""Reports over the chain's tables, listings and names of files, and committed or quarantined runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stillwave import config
from stillwave.functions import columns as C
from stillwave.operators import chunks as K
from stillwave.operators import jobs, snapshots
from stillwave.operators.quarantine import Quarantine
from stillwave.plans import bindings as B
from stillwave.plans.source_queries import by_row, traces
from stillwave.session import scratch, table
from stillwave.sources import headers, inventory, miniseed, soh

PLANS = B.Plans()


@PLANS.add("jn24_coverage", f"""WITH {B.SAMPLES_SQL}, c AS (SELECT timespan_id, user_id, count(*) AS npts FROM sample WHERE event_type <> 'error' GROUP BY ALL),
g AS (SELECT timespan_id, user_id, avg(value) AS error FROM sample WHERE event_type = 'error' GROUP BY ALL)
SELECT timespan_id, user_id, npts, round(error, 6) + 0.0 AS error, CASE WHEN npts IS NULL THEN 'state only' WHEN error IS NULL THEN 'samples only' ELSE 'both' END AS held FROM c FULL JOIN g USING (timespan_id, user_id)""")
def jn24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each device's windows with samples, with records of its state, or with both."""
    s, key = B.samples(spark, sf_dir), ["timespan_id", "user_id"]
    samples = s.filter("event_type <> 'error'").groupBy(*key).agg(F.count("*").alias("npts"))
    states = s.filter("event_type = 'error'").groupBy(*key).agg(F.avg("value").alias("error"))
    held = F.when(F.col("npts").isNull(), "state only").when(F.col("error").isNull(), "samples only").otherwise("both")
    return samples.join(states, key, "full").select(*key, "npts", C.rounded(F.col("error")).alias("error"), held.alias("held"))


@PLANS.add("ag20_availability_cube", f"WITH {B.SAMPLES_SQL} SELECT event_type, timespan_id, count(*) AS npts, count(DISTINCT user_id) AS devices, CAST(grouping(event_type, timespan_id) AS BIGINT) AS level FROM sample GROUP BY CUBE (event_type, timespan_id) HAVING count(*) >= 2")
def ag20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and devices by type and window, by either, and in all."""
    by = B.samples(spark, sf_dir).cube("event_type", "timespan_id")
    return by.agg(F.count("*").alias("npts"), F.count_distinct("user_id").alias("devices"), F.grouping_id().alias("level")).filter("npts >= 2")


@PLANS.add("wn12_daily_ranks", f"""WITH {B.SAMPLES_SQL}, d AS (SELECT event_type, timespan_id, avg(value) AS m FROM sample GROUP BY ALL)
SELECT event_type, timespan_id, CAST(rank() OVER (PARTITION BY event_type ORDER BY m DESC) AS INTEGER) AS place, CAST(ntile(4) OVER (PARTITION BY event_type ORDER BY m DESC, timespan_id) AS INTEGER) AS quarter,
round(m - lag(m) OVER o, 6) + 0.0 AS since_before, round(lead(m) OVER o - m, 6) + 0.0 AS until_next FROM d WINDOW o AS (PARTITION BY event_type ORDER BY timespan_id)""")
def wn12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows' means by their rank among those of their type, and beside their neighbours'. The
    windows of a type, not its samples, are what is sorted."""
    d = B.samples(spark, sf_dir).groupBy("event_type", "timespan_id").agg(F.avg("value").alias("m"))
    along, down = Window.partitionBy("event_type").orderBy("timespan_id"), Window.partitionBy("event_type").orderBy(F.desc("m"))
    return d.select(
        "event_type", "timespan_id", F.rank().over(down).alias("place"), F.ntile(4).over(Window.partitionBy("event_type").orderBy(F.desc("m"), "timespan_id")).alias("quarter"),
        C.rounded(F.col("m") - F.lag("m").over(along)).alias("since_before"), C.rounded(F.lead("m").over(along) - F.col("m")).alias("until_next"),
    )


@PLANS.add("sc16_properties", r"""SELECT CAST(regexp_extract(props, '"k": *(\d+)', 1) AS INTEGER) AS k, count(*) AS n, round(avg(value), 6) + 0.0 AS mean FROM events GROUP BY k""")
def sc16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by a property that they carry as JSON."""
    e = table(spark, sf_dir, "events").select(F.from_json("props", "k int").alias("p"), "value")
    return e.groupBy(F.col("p.k").alias("k")).agg(F.count("*").alias("n"), C.rounded(F.avg("value")).alias("mean"))


@PLANS.add("or2_pages", "SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 500 AS page FROM events")
def or2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in pages of 500 in a stable order, numbered day by day without a sort of all."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.to_date("ts").alias("day"), F.lit(0).alias("all"))
    return K.numbered(e, ["all"], "day", ["ts", "event_id"], "place").select("event_id", F.floor((F.col("place") - 1) / 500).alias("page"))


@PLANS.add("src3_directories", f"WITH {B.WAVEFORMS_SQL} SELECT 'S' || label AS station, CAST(count(*) AS BIGINT) AS files, CAST(sum(len(x)) AS BIGINT) AS npts FROM wave GROUP BY label")
def src3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories by station, indexed in two runs, of which the second finds those of the first again."""
    folder = scratch(spark, "directories").removeprefix("file://").removeprefix("file:")
    miniseed.write_files(miniseed.encoded(traces(spark, sf_dir)), folder).agg(F.sum("bytes")).collect()
    index = spark.createDataFrame([], miniseed.time_series_index(headers.read_headers(spark, folder, "nothing")).schema)
    for place in (f"{folder}/SW/S1", folder):
        index = jobs.index(headers.read_headers(spark, place), index)
    return index.groupBy("station").agg(F.count("*").alias("files"), F.sum("npts").alias("npts"))


@PLANS.add("src10_state_files", "SELECT kind, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT CASE WHEN user_id % 3 = 0 THEN 'environment' ELSE 'gpstime' END AS kind, user_id, sum(length(CAST(event_id AS VARCHAR)) + 1) AS bytes FROM events WHERE user_id % 3 < 2 GROUP BY ALL) GROUP BY kind")
def src10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of three kinds in one tree, listed kind by kind by the glob of its format; those of the
    third kind, which no glob of the two names, aren't found."""
    name = F.when(F.col("user_id") % 3 == 0, "XX_EnvironmentSOH_%d.csv").when(F.col("user_id") % 3 == 1, "XX_GPSTime_%d.csv").otherwise("XX_other_%d.csv")
    lines = table(spark, sf_dir, "events").groupBy("user_id").agg(F.concat_ws("", F.array_sort(F.collect_list(F.concat(F.col("event_id").cast("string"), F.lit("\n"))))).alias("text"))
    path = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.replace(name, F.lit("%d"), F.col("user_id").cast("string")))
    folder = scratch(spark, "states").removeprefix("file://").removeprefix("file:")
    miniseed.write_files(lines.select(path.alias("path"), F.encode("text", "UTF-8").alias("content")), folder).agg(F.sum("bytes")).collect()
    found = [soh.list_files(spark, folder, soh.soh_format("taurus", kind).glob).select(F.lit(kind).alias("kind"), "length") for kind in ("environment", "gpstime")]
    return found[0].unionByName(found[1]).groupBy("kind").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


@PLANS.add("sc13_lengths", "SELECT p_partkey, CAST(p_size * 60 + p_size % 7 AS DOUBLE) AS seconds FROM part")
def sc13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of time as configurations write them, in seconds."""
    text = F.format_string("%d min %d s", "p_size", F.col("p_size") % 7)
    return by_row(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey long, seconds double", lambda key, value: (key, config.seconds(value)))


@PLANS.add("cfg1_params_of_rows", "SELECT s_suppkey, CAST(s_nationkey + 8 AS DOUBLE) AS sampling_rate, round(1 - (0.5 + s_nationkey / 100.0), 6) + 0.0 AS tolerance, s_nationkey % 2 = 0 AS remove_response FROM supplier")
def cfg1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of chunks from each supplier's section of a file; the tolerance follows from the threshold."""
    text = F.format_string("[DatachunkParams]\nsampling_rate = %d\ndatachunk_sample_threshold = %.2f\nremove_response = %s\n", F.col("s_nationkey") + 8, F.col("s_nationkey") / 100.0 + 0.5, (F.col("s_nationkey") % 2 == 0).cast("string"))

    def params(key: int, toml: str) -> tuple:
        p = config.parse(toml, "DatachunkParams")
        return key, float(p.sampling_rate), round(p.datachunk_sample_tolerance, 6), p.remove_response

    return by_row(table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text")), "s_suppkey long, sampling_rate double, tolerance double, remove_response boolean", params)


@PLANS.add("ldr2_result_names", f"""WITH {B.COMPONENTS_SQL}, {B.SPANS_SQL}, k AS (SELECT unnest(['psd', 'beam', 'event', 'ccf']) AS kind)
SELECT component_id, timespan_id, kind, kind || '/' || year(midtime) || '/' || replace(network, ' ', '_') || '/' || station || '/' || component || '/' || replace(network, ' ', '_') || '.' || station || '.' || component || '.' || kind || '.' || strftime(midtime, '%Y.%j.%H%M') AS path
FROM component, span, k WHERE timespan_id < 3""")
def ldr2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of four kinds of results for all components and the first three windows."""
    spans = B.spans_of_events(spark, sf_dir).filter("timespan_id < 3")
    kinds = F.explode(F.array(*map(F.lit, ("psd", "beam", "event", "ccf")))).alias("kind")
    c = B.components(spark, sf_dir).select("component_id", "network", "station", "component", kinds)
    windows = spans.agg(F.collect_list(F.struct("timespan_id", "midtime")).alias("w"))
    each = c.join(F.broadcast(windows)).select("*", F.explode("w").alias("s")).select("component_id", "s.timespan_id", "kind", "network", "station", "component", "s.midtime")  # one row
    return each.select("component_id", "timespan_id", "kind", inventory.result_path(F.col("kind"), F.col("network"), F.col("station"), F.col("component"), F.col("midtime")).alias("path"))


@PLANS.add("snk7_committed_statistics", f"WITH {B.CHUNKS_SQL} SELECT timespan_id, event_type, npts, round(mean, 6) + 0.0 AS mean, round(variance, 6) + 0.0 AS variance FROM chunk")
def snk7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of all chunks in two committed increments: half of the windows, then what is missing."""
    key, s = ["timespan_id", "event_type"], B.samples(spark, sf_dir)
    kept = snapshots.Snapshots.create(spark, scratch(spark, "statistics"), K.statistics(s, key).schema, key, buckets=8)
    for part in (s.filter("timespan_id < 15"), s):
        jobs.committed(kept, part, key, lambda new: K.statistics(new, key))
    return kept.read().select(*key, "npts", C.rounded(F.col("mean")).alias("mean"), C.rounded(F.col("variance")).alias("variance"))


@PLANS.add("run2_quarantined_items", f"WITH {B.WAVEFORMS_SQL}, p AS (SELECT vec_id, list_max(x) > 0.35 AS bad FROM wave) SELECT vec_id, CASE WHEN bad THEN 'samples that aren''t finite' END AS problem, NOT bad AS done FROM p")
def run2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All waveforms processed, where a sample over 0.35 is a fault of the recorder: those that have
    one are quarantined, the others have a result."""
    broken = F.transform("x", lambda v: F.when(v > 0.35, F.lit(float("nan"))).otherwise(v))
    w = B.waveforms(spark, sf_dir).select(F.lit(1).cast("long").alias("component_id"), F.col("vec_id").alias("timespan_id"), broken.alias("samples"))
    kept = Quarantine(spark)
    params = config.ProcessedDatachunkParams(filtering_low=2.0, filtering_high=16.0)
    done = jobs.processed(w, spark.createDataFrame([], w.schema), params, 64.0, quarantine=kept).select(F.col("timespan_id").alias("vec_id"), F.lit(True).alias("done"))
    bad = kept.table().select(F.from_json("item", "component_id long, timespan_id long")["timespan_id"].alias("vec_id"), "problem")
    return done.join(bad, "vec_id", "full").select("vec_id", "problem", F.coalesce("done", F.lit(False)).alias("done"))
