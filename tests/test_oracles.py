"""Every registered query of the library against its SQL twin in DuckDB."""

import math
import os

import duckdb
import pytest

from stillwave.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{sf}/{t}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "None"
    if isinstance(v, float):
        return f"{v + 0.0:.9g}"
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in catalogue.ORACLES:
        assert rows
        return
    found = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    assert columns == sorted(names)
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_flagship(spark, sf):
    df = catalogue.flagship(spark, sf)
    assert "is_passing" in df.columns and df.count() > 0
