import datetime as dt

import pytest
from pyspark.sql import functions as F

from stillwave.functions import columns as C
from stillwave.operators import chunks, grid, inventory, stacking

TS = lambda s: dt.datetime.fromisoformat(s)


@pytest.fixture(scope="module")
def nine(spark):
    """Three stations of three components, all active, on different meridians."""
    rows = [(3 * s + i + 1, "TD", f"TD0{s}", c, 30.0 + s, 8.0 + s, TS("2016-01-01"), TS("2020-01-01")) for s in range(3) for i, c in enumerate("ENZ")]
    return spark.createDataFrame(rows, "component_id long, network string, station string, component string, lat double, lon double, start_date timestamp_ntz, end_date timestamp_ntz")


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


@pytest.mark.parametrize(("n", "exponent"), [(3.0, 2), (3.3, 2), (100.0, 7), (55.58, 6)])
def test_next_power(spark, n, exponent):
    assert one(spark, C.next_power_exponent(F.lit(n))) == exponent


@pytest.mark.parametrize(("b", "expected"), [((0, 1), False), ((0, 2), True), ((3, 4), True), ((5, 9), True), ((6, 9), False), ((0, 9), True)])
def test_overlap_is_inclusive_and_symmetric(spark, b, expected):
    a = (F.lit(2), F.lit(5))
    assert one(spark, C.overlaps(*a, F.lit(b[0]), F.lit(b[1]))) is expected
    assert one(spark, C.overlaps(F.lit(b[0]), F.lit(b[1]), *a)) is expected


@pytest.mark.parametrize(("end", "expected"), [("2016-02-05", False), ("2016-01-08", True), ("2016-01-07 20:00:00", True)])
def test_same_day(spark, end, expected):
    ntz = lambda s: F.lit(s).cast("timestamp_ntz")
    assert one(spark, C.same_day(ntz("2016-01-07"), ntz(end))) is expected


def test_null_safe(spark):
    nan = float("nan")
    for a, b, expected in [(1.0, 2.0, True), (3.0, 2.0, False), (None, 2.0, None), (1.0, None, None), (nan, 2.0, None), (1.0, nan, None)]:
        for policy in (True, False):
            got = one(spark, C.compare_null_safe(F.lit(a).cast("double"), F.lit(b).cast("double"), "<=", policy))
            assert got is (policy if expected is None else expected)


def test_backazimuth_follows_the_divisor(spark):
    for x, y in [(1.0, 1.0), (-1.0, 1.0), (-1.0, -1.0), (0.0, -1.0)]:
        import math

        expected = math.degrees(math.atan2(x, y)) % -360 + 180
        assert one(spark, C.backazimuth(F.lit(x), F.lit(y))) == pytest.approx(expected)


def test_pair_counts(nine):
    pairs = inventory.pairs(nine)
    count = lambda **k: inventory.choose_pairs(pairs, **k).count()
    assert count() == 27
    assert count(include_auto=True, include_intra=True) == 54
    assert (count(only_auto=True), count(only_intra=True)) == (9, 18)
    with pytest.raises(ValueError):
        count(only_auto=True, only_intra=True)
    assert pairs.filter("not autocorrelation and not intracorrelation and backazimuth < 180").count() == 0
    assert inventory.cylindrical_pairs(pairs).count() == 3 * 8


def test_grid(spark):
    assert grid.timespans(spark, "2016-01-07", "2016-01-10", 1800).count() == 144
    assert grid.timespans(spark, "2016-01-07", "2016-01-10", 7200, overlap_s=3600).count() < grid.timespans(spark, "2016-01-07", "2016-01-10", 7200, overlap_s=3600, across_midnight=True).count()
    with pytest.raises(ValueError):
        grid.window_step(10, overlap_s=10)


def test_rejected_periods(spark):
    c = spark.createDataFrame([("k1", 1, TS("2023-02-05"), TS("2023-02-06")), ("k2", 2, TS("2023-02-05"), TS("2023-02-06"))], "chunk_id string, component_id int, starttime timestamp_ntz, endtime timestamp_ntz")
    for (s, e), ok in {("2023-01-01", "2023-01-02"): True, ("2023-02-05 05:00:00", "2023-02-05 06:00:00"): False, ("2023-02-06", "2023-02-09"): False, ("2023-01-01", "2023-03-01"): False}.items():
        p = spark.createDataFrame([(1, TS(s), TS(e))], "component_id int, starttime timestamp_ntz, endtime timestamp_ntz")
        found = {r.chunk_id: r.ok_accepted_time for r in chunks.outside_rejected(c, p, "component_id").collect()}
        assert found == {"k1": ok, "k2": True}


def test_quality_bounds_both_ways(spark):
    df = spark.createDataFrame([(5.0,), (None,)], "mean double")
    sane = chunks.bounds_verdicts({"mean_min": 1.0, "mean_max": 3.0}, True)
    assert [tuple(r) for r in df.select(*sane).collect()] == [(True, False), (True, True)]
    swapped = chunks.bounds_verdicts({"mean_min": 1.0, "mean_max": 3.0}, False, inverted=True)
    assert [tuple(r) for r in df.select(*swapped).collect()] == [(False, True), (False, False)]


def test_missing_statistics_and_gps(spark):
    """A chunk without a GPS row or statistics stays, with nulls, unless strict; its verdicts
    are then the policy's."""
    c = spark.createDataFrame([(1, 2.0), (2, None)], "k int, mean double")
    gps = spark.createDataFrame([(1, 5.0)], "k int, error double")
    assert sorted(map(tuple, chunks.with_gps(c, gps, ["k"], strict=False).collect())) == [(1, 2.0, 5.0), (2, None, None)]
    assert [tuple(r) for r in chunks.with_gps(c, gps, ["k"], strict=True).collect()] == [(1, 2.0, 5.0)]
    for policy in (True, False):
        verdicts = [*chunks.bounds_verdicts({"mean_max": 3.0}, policy), *chunks.bounds_verdicts({"error_max": 4.0}, policy)]
        found = chunks.with_gps(c, gps, ["k"], strict=False).orderBy("k").select(*verdicts).collect()
        assert [tuple(r) for r in found] == [(True, False), (policy, policy)]


def test_numbered(spark):
    rows = [("a", d, i) for d in (3, 1, 2, None) for i in range(4)] + [(None, 1, 0), ("b", 2, 9)]
    df = spark.createDataFrame(rows, "k string, d int, i int")
    places = {(r.k, r.d, r.i): r.n for r in chunks.numbered(df, ["k"], "d", ["i"], "n").collect()}
    expected = {r: n for n, r in enumerate(sorted((x for x in rows if x[0] == "a"), key=lambda r: (r[1] or 0, r[2])), 1)}
    assert places == expected | {(None, 1, 0): 1, ("b", 2, 9): 1}


def test_upsert_and_ids(spark):
    old, new = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(chunks.upsert(old, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(chunks.upsert(old, new, ["k"], nothing_on_conflict=True)) == [(1, "a"), (2, "b"), (3, "d")]
    twice = new.unionByName(spark.createDataFrame([(3, "e"), (2, "a")], "k int, v string"))
    assert rows(chunks.upsert(old, twice, ["k"])) == [(1, "a"), (2, "c"), (3, "e")]
    assert chunks.next_id(old, "k").first().next_id == 3
    assert chunks.next_id(old.filter("k > 9"), "k").first().next_id == 1


def test_run_lengths(spark):
    flags = [True, True, False, True, False, False, True, True, True]
    df = spark.createDataFrame([(0, i, f) for i, f in enumerate(flags)], "g int, i int, f boolean")
    assert sorted(r.length for r in chunks.run_lengths(df, ["g"], "i", "f").collect()) == [1, 2, 3]


def test_stack_of_copies_is_the_copy(spark):
    df = spark.createDataFrame([(1, [1.0, -2.0, 3.0])] * 4, "k int, y array<double>")
    assert stacking.linear_stack(df, ["k"], "y", least=4).first().stack == [1.0, -2.0, 3.0]
    assert stacking.linear_stack(df, ["k"], "y", least=5).count() == 0


def test_range_join_has_no_nested_loop(spark):
    points = spark.range(100).select(F.timestamp_seconds("id").cast("timestamp_ntz").alias("t"))
    spans = points.select(F.col("t").alias("s"), (F.col("t") + F.expr("interval 3 seconds")).alias("e"))
    joined = grid.bucketed_range_join(points, spans, "t", "s", "e", 10)
    assert joined.count() == 3 * 100 - 3
    assert "NestedLoop" not in joined._jdf.queryExecution().toString()


def test_pairs_in_blocks(spark, sf, monkeypatch):
    """Blocks of any size give the pairs of one block."""
    from stillwave.operators import inventory
    from stillwave.plans import bindings

    c = bindings.components(spark, sf)
    key = lambda df: sorted(map(tuple, df.select("component_id_a", "component_id_b", "intracorrelation", "distance").collect()))
    whole = key(inventory.pairs(c))
    monkeypatch.setattr(inventory, "BLOCK", 7)
    assert key(inventory.pairs(c)) == whole and len(whole) == len({w[:2] for w in whole})
    assert "CartesianProduct" not in inventory.pairs(c)._jdf.queryExecution().executedPlan().toString() and inventory.pairs(c.filter("false")).count() == 0


def test_overlapping_pairs(spark):
    import datetime as dt

    from stillwave.operators import grid

    at = lambda h: dt.datetime(2020, 1, 1) + dt.timedelta(hours=h)
    rows = [(i, i % 2, at((i * 7) % 50), at((i * 7) % 50 + i % 9)) for i in range(60)] + [(99, None, at(0), at(1)), (98, 1, None, at(1))]
    found = grid.overlapping_pairs(spark.createDataFrame(rows, "i long, k long, s timestamp_ntz, e timestamp_ntz"), ["k"], "s", "e", 3 * 3600)
    good = [r for r in rows if None not in r]
    assert sorted((r.ia, r.ib) for r in found.collect()) == sorted((a[0], b[0]) for a in good for b in good if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3])
