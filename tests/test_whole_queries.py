"""Queries whose rows are those of the whole table."""

import duckdb
import pytest

from stillwave.plans import catalogue

WINDOWS = "select distinct date_diff('day', date '2024-01-01', cast(ts as date)), event_type from '{}/events.parquet'"


@pytest.mark.parametrize("name", ["qcv4_gps_bounds", "jn4_chunks_gps_stats"])
def test_every_window_has_its_gps_row(spark, sf, name):
    """No day's samples are left out, in the query or in its SQL."""
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf}/events.parquet'")
    windows = sorted(con.execute(WINDOWS.format(sf)).fetchall())
    assert sorted((r.timespan_id, r.event_type) for r in catalogue.QUERIES[name](spark, sf).collect()) == windows
    assert sorted(con.execute(f"select timespan_id, event_type from ({catalogue.ORACLES[name]})").fetchall()) == windows


def test_a_table_is_a_file_or_a_folder(spark, tmp_path):
    """A folder's files count as the one table that they are."""
    (tmp_path / "documents.parquet").mkdir()
    for name in ("documents.parquet/part-0000.parquet", "documents.parquet/part-0001.parquet", "region.parquet", "notes.txt"):
        (tmp_path / name).write_bytes(b"1")
    found = catalogue.QUERIES["src1_files"](spark, str(tmp_path)).collect()
    assert sorted((r.name, r.filled) for r in found) == [("documents.parquet", True), ("region.parquet", True)]
