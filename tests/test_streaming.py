import datetime as dt
import os
import random
import shutil

from pyspark.sql import functions as F

from stillwave import streaming
from stillwave.operators import chunks


def test_stream_matches_bounded_run(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp_ltz"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = streaming.chunk_statistics(stream).writeStream.outputMode("complete").format("memory").queryName("chunk_stats").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.starttime.day, r.event_type): (r.npts, round(r.mean, 6)) for r in spark.table("chunk_stats").collect()}
    expected = chunks.statistics(events.withColumn("day", F.dayofmonth("ts")), ["day", "event_type"]).collect()
    assert got == {(r.day, r.event_type): (r.npts, round(r["mean"], 6)) for r in expected}


def test_triggers_of_a_replayed_stream(spark, sf, tmp_path):
    """Events in shuffled order by files of a few days each, with late rows and nulls: what comes
    out are the events of the sorted sequence, but those still open."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp_ltz").alias("ts"), "event_type", "value")
        rows = sorted(map(tuple, e.collect()))
        far = rows[-1][0] + dt.timedelta(days=30)
        for part in range(5):  # each file has the days of its own and some of the next one's
            mine = [r for i, r in enumerate(rows) if (r[0].day + (i * 7919) % 3) // 7 == part]
            random.Random(part).shuffle(mine)
            mine += [(rows[0][0], "late", 1e9)] if part == 4 else [(mine[0][0], "null", None), (mine[0][0], "null", float("nan"))]
            spark.createDataFrame(mine, e.schema).coalesce(1).write.parquet(str(tmp_path / "parts" / f"{part}"))
        for part in (5, 6):
            spark.createDataFrame([(far + dt.timedelta(days=part), "end", 0.0)], e.schema).coalesce(1).write.parquet(str(tmp_path / "parts" / f"{part}"))
        os.makedirs(tmp_path / "in")
        for part in range(7):
            (file,) = (tmp_path / "parts" / f"{part}").glob("*.parquet")
            place = tmp_path / "in" / f"{part}.parquet"
            shutil.copy(file, place)
            os.utime(place, (1_700_000_000 + part, 1_700_000_000 + part))
        stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        found = streaming.triggers(stream, 60.0, 20.0, late="4 days")
        query = found.writeStream.outputMode("append").format("memory").queryName("triggered").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(300)
        got = sorted((r.event_type, r.start, r.stop, r.npts, round(r.peak, 6)) for r in spark.table("triggered").collect())
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    expected = []
    for kind in {r[1] for r in rows}:
        run = None
        for at, _, v in (r for r in rows if r[1] == kind):
            if run and v > 20.0 or v > 60.0:
                run = (run[0], at, run[2] + 1, max(run[3], abs(v))) if run else (at, at, 1, abs(v))
            elif run:
                expected.append((kind, *run[:3], round(run[3], 6)))
                run = None
    assert len(expected) > 50 and got == sorted(expected)
