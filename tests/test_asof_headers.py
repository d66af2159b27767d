"""As-of joins by buckets, and the source of headers."""

import datetime as dt
import io
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillwave.operators import grid
from stillwave.sources import headers, miniseed

AT = dt.datetime(2020, 1, 1)


def expected(left, right, tolerance):
    out = []
    for i, key, t in left:
        held = [(rt, v) for rk, rt, v in right if key is not None and t is not None and rk == key and rt is not None and rt <= t]
        best = max(held, default=None, key=lambda h: (h[0], -1e18 if h[1] is None else h[1]))
        out.append((i, best[1] if best and (tolerance is None or (t - best[0]).total_seconds() <= tolerance) else None, best is not None and (tolerance is None or (t - best[0]).total_seconds() <= tolerance)))
    return sorted(out)


@pytest.mark.parametrize("tolerance, bucket, carried", [(None, 3600, 4), (7200, 3600, 4), (0, 60, 2), (None, 10**6, 1), (50_000, 7, 1000)])
def test_as_of_by_brute_force(spark, tolerance, bucket, carried):
    """Ties, null keys and times, keys of one side, rows before 1970, one key of most rows."""
    rng = np.random.default_rng(bucket)
    moment = lambda: None if rng.random() < 0.05 else AT + dt.timedelta(seconds=int(rng.integers(-60, 200)) * 600)
    key = lambda: None if rng.random() < 0.05 else "hot" if rng.random() < 0.6 else str(rng.integers(0, 4))
    left = [(i, key(), moment()) for i in range(300)] + [(900, "only left", AT), (901, "hot", dt.datetime(1960, 1, 1)), (902, "0", AT)]
    right = [(key(), moment(), None if rng.random() < 0.1 else float(rng.integers(0, 5))) for _ in range(150)] + [("only right", AT, 1.0), ("hot", dt.datetime(1950, 1, 1), 7.0), ("0", AT, 3.0), ("0", AT, 4.0)]
    a = spark.createDataFrame(left, "id long, k string, t timestamp_ntz").withColumns({"value": F.lit("clash"), "_b": F.lit(1), "_t": F.lit(2)})
    b = spark.createDataFrame(right, "k string, t timestamp_ntz, value double").repartition(3)
    found = grid.as_of(a, b, ["k"], "t", "t", tolerance_s=tolerance, bucket_s=bucket, carried=carried).collect()
    assert all(r.value == "clash" and (r["_b"], r["_t"]) == (1, 2) for r in found)
    assert sorted((r.id, r.found and r.found.value, r.found is not None) for r in found) == expected(left, right, tolerance)


def test_as_of_without_rows(spark):
    a = spark.createDataFrame([(1, "x", AT), (1, "x", AT)], "id long, k string, t timestamp_ntz")
    b = spark.createDataFrame([], "k string, t timestamp_ntz, value double")
    assert [r.found for r in grid.as_of(a, b, ["k"], "t", "t").collect()] == [None, None]
    assert grid.as_of(a.filter("false"), b, ["k"], "t", "t").count() == 0


# Headers


class Counted(io.BytesIO):
    def __init__(self, data):
        super().__init__(data)
        self.read_bytes = 0

    def read(self, n=-1):
        found = super().read(n)
        self.read_bytes += len(found)
        return found


def trace(station, start, n, length=512, rate=8.0):
    return miniseed.encode("SW", station, "", "HHZ", AT + dt.timedelta(seconds=start), rate, np.arange(n, dtype=float), length)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("records")
    for k, (station, n) in enumerate((("A", 500), ("A", 3), ("B", 1000), ("C", 56))):
        (root / station).mkdir(exist_ok=True)
        (root / station / f"{k}.mseed").write_bytes(trace(station, 1000 * k, n, 512 if k != 2 else 4096))
    (root / "A" / "empty.mseed").write_bytes(b"")
    (root / "A" / "notes.txt").write_text("x" * 5000)
    return root


def test_only_headers_are_read():
    data = trace("A", 0, 5000)
    file = Counted(data)
    found = list(headers.walk(file, 0, len(data)))
    assert sum(h.npts for _, h in found) == 5000 and [o for o, _ in found] == list(range(0, len(data), 512))
    assert file.read_bytes <= headers.HEAD * len(found) < len(data) / 7


@pytest.mark.parametrize("step", [1, 511, 512, 513, 1500, 10**6])
def test_ranges_share_no_record(step):
    data = trace("A", 0, 700)
    offsets = [o for s in range(0, len(data), step) for o, _ in headers.walk(Counted(data), s, min(len(data), s + step))]
    assert offsets == list(range(0, len(data), 512))


def test_far_blockettes_and_unequal_records():
    data = bytearray(trace("A", 0, 10, 512))
    data[46:48] = (200).to_bytes(2, "big")  # the blockette stands behind the first 64 bytes
    data[200:208], data[48:56] = data[48:56], bytes(8)
    (_, h), = headers.walk(Counted(bytes(data)), 0, len(data))
    assert h.length == 512 and h.encoding == 5
    with pytest.raises(ValueError, match="4096 bytes at 512 among those of 512"):
        list(headers.walk(Counted(trace("A", 0, 10, 512) + trace("A", 9, 10, 4096)), 0, 5000))
    assert list(headers.walk(Counted(b""), 0, 0)) == [] and list(headers.walk(Counted(b"short"), 0, 5)) == []


@pytest.mark.parametrize("size", [700, 1 << 30])
def test_index_equals_that_of_decoded_records(spark, folder, size):
    key = lambda df: sorted((r.path.split("/")[-1], *tuple(r)[1:]) for r in df.collect())
    by_headers = miniseed.time_series_index(headers.read_headers(spark, str(folder), "*.mseed", size))
    assert key(by_headers) == key(miniseed.time_series_index(miniseed.read_miniseed(spark, str(folder), "*.mseed")))


def test_filters_are_tested_where_headers_are_read(spark, folder):
    found = headers.read_headers(spark, str(folder), "*.mseed")
    late = AT + dt.timedelta(seconds=1000)
    some = found.filter((F.col("station") == "A") & (F.col("starttime") >= F.lit(late)) & (F.col("npts") > 1))
    assert [(r.station, r.npts) for r in some.collect()] == [("A", 3)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    left = plan.split("BatchScan")[0]
    assert re.search(r"npts#\d+L? > 1", left) and not re.search(r"station#\d+ = |starttime#\d+ >=", left)
    assert found.filter(F.col("station").isin("A", "C")).groupBy("station").agg(F.sum("npts").alias("n")).orderBy("station").collect() == [("A", 503), ("C", 56)]
    assert "samples" not in found.columns and headers.read_headers(spark, str(folder), "nothing*").count() == 0
    with pytest.raises(Exception, match="only Spark reads"):
        headers.read_headers(spark, "viewfs://store/in").count()


def test_written_files_are_whole(spark, tmp_path):
    rows = [("a/b/1", b"x" * 10), ("a/2", b"")]
    done = miniseed.write_files(spark.createDataFrame(rows, "path string, content binary"), str(tmp_path)).collect()
    assert sorted((r.path, r.bytes) for r in done) == [("a/2", 0), ("a/b/1", 10)] and sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["1", "2"]


def test_a_tampered_file_is_named_without_reading_others(spark, tmp_path):
    rows = [(f"{i}.bin", bytes([i]) * (i + 1)) for i in range(8)]
    noted = spark.createDataFrame(miniseed.write_files(spark.createDataFrame(rows, "path string, content binary"), str(tmp_path)).collect()).withColumns({"problem": F.lit("old"), "kept": F.lit(1)})
    whole = {r.path: (bytes(r.content), r.problem, r.kept) for r in miniseed.checked(noted, str(tmp_path)).collect()}
    assert whole == {p: (c, None, 1) for p, c in rows}
    (tmp_path / "3.bin").write_bytes(b"\x00" * 4)  # the same length
    (tmp_path / "4.bin").write_bytes(b"longer than it was")
    (tmp_path / "5.bin").unlink()
    (tmp_path / "6.bin").chmod(0)
    wanted = noted.filter("path in ('1.bin', '3.bin', '4.bin', '5.bin')").unionByName(noted.limit(1).withColumn("path", F.lit(None).cast("string")))
    found = {r.path: r.problem for r in miniseed.checked(wanted, str(tmp_path), strict=False).collect()}
    assert found["1.bin"] is None and found["3.bin"].startswith("3.bin: the content's digest") and found["4.bin"] == "4.bin: 18 bytes instead of 5"
    assert found["5.bin"] == "5.bin: missing" and found[None] == "no file"
    for name in ("3.bin", "4.bin", "5.bin"):
        with pytest.raises(Exception, match=name):
            miniseed.checked(noted.filter(F.col("path") == name), str(tmp_path)).collect()
    assert miniseed.checked(noted.filter("path = '2.bin'"), str(tmp_path)).count() == 1
