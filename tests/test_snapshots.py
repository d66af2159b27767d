"""Committed upserts: increments, failures, conflicts, files that stay."""

import pytest
from pyspark.sql import functions as F

from stillwave.operators import snapshots

SCHEMA = "k long, s string, v double"


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def table(spark, tmp_path):
    return snapshots.Snapshots.create(spark, str(tmp_path / "table"), SCHEMA, ["k", "s"], buckets=16)


def frame(spark, values):
    return spark.createDataFrame(values, SCHEMA)


def test_two_increments(spark, table):
    first = [(i, "a", float(i)) for i in range(200)]
    assert table.upsert(frame(spark, first)) == 1
    before = table.manifest()["files"]
    assert table.upsert(frame(spark, [(3, "a", -1.0), (500, "b", 5.0), (3, "a", -2.0)]).withColumn("other", F.lit(1))) == 2
    assert rows(table.read()) == sorted([r for r in first if r[0] != 3] + [(3, "a", -1.0), (500, "b", 5.0)])
    assert rows(table.read(1)) == first and table.versions() == [0, 1, 2]
    after = table.manifest()["files"]
    same = [b for b in before if after[b] == before[b]]
    assert 14 <= len(same) < 16 and all(before[b] != after[b] for b in set(before) - set(same))


def test_leave_on_conflict_and_nothing_new(spark, table):
    table.upsert(frame(spark, [(1, "a", 1.0)]))
    table.upsert(frame(spark, [(1, "a", 9.0), (2, "a", 2.0)]), nothing_on_conflict=True)
    assert rows(table.read()) == [(1, "a", 1.0), (2, "a", 2.0)]
    assert table.upsert(frame(spark, [])) == 2 and table.versions() == [0, 1, 2]


def test_a_failed_run_leaves_the_old_snapshot(spark, table):
    table.upsert(frame(spark, [(1, "a", 1.0)]))
    bad = frame(spark, [(1, "a", 2.0), (2, "b", 3.0)]).withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        table.upsert(bad)
    with pytest.raises(ValueError, match="null in the key"):
        table.upsert(frame(spark, [(None, "a", 2.0)]))
    again = snapshots.Snapshots(spark, table.path)
    assert rows(again.read()) == [(1, "a", 1.0)] and again.versions() == [0, 1]
    assert again.upsert(frame(spark, [(2, "b", 3.0)])) == 2 and rows(table.read()) == [(1, "a", 1.0), (2, "b", 3.0)]


def test_of_two_writers_one_publishes(spark, table, monkeypatch):
    """The second finds the version taken when it publishes; its rows aren't mixed in."""
    held = table.manifest()
    other = snapshots.Snapshots(spark, table.path)
    monkeypatch.setattr(other, "manifest", lambda version=None: held)
    table.upsert(frame(spark, [(1, "a", 1.0)]))
    with pytest.raises(snapshots.Conflict):
        other.upsert(frame(spark, [(1, "a", 2.0)]))
    assert rows(table.read()) == [(1, "a", 1.0)]
    with pytest.raises(snapshots.Conflict):
        snapshots.Snapshots.create(spark, table.path, SCHEMA, ["k"])
    with pytest.raises(ValueError):
        snapshots.Snapshots(spark, table.path + "x").read()
    with pytest.raises(ValueError):
        snapshots.Snapshots.create(spark, table.path + "y", SCHEMA, ["nothing"])
