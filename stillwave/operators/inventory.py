"""Stations, components and their pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillwave.functions import columns as C

#: Codes of the rotated components, and the original ones that each needs.
CYLINDRICAL = {
    "RR": ("E", "N", "E", "N"), "TT": ("E", "N", "E", "N"), "RT": ("E", "N", "E", "N"), "TR": ("E", "N", "E", "N"),
    "RZ": ("E", "N", "Z", None), "TZ": ("E", "N", "Z", None), "ZR": ("Z", None, "E", "N"), "ZT": ("Z", None, "E", "N"),
}


def every(tests: list[Column | None]) -> Column:
    """All of the tests that are given; true without any."""
    return reduce(lambda a, b: a & b, [t for t in tests if t is not None], F.lit(True))


def components(df: DataFrame, networks=None, stations=None, codes=None, ids=None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Components by network, station, code, id and active period; without any, all."""
    active = None
    if start is not None and end is not None:
        active = C.overlaps(start, end, F.col("start_date"), F.col("end_date"))
    wanted = [("network", networks), ("station", stations), ("component", codes), ("component_id", ids)]
    return df.filter(every([*(F.col(c).isin(list(v)) if v else None for c, v in wanted), active]))


#: Components in a block, on average.
BLOCK = 1024


def pairs(df: DataFrame, prune_by_time: bool = False) -> DataFrame:
    """Ordered pairs of components: those of one component (autocorrelation), those of one
    station, and those whose first station lies east of the second.

    Components are dealt to blocks, and each pair of blocks meets by its numbers, so a task has
    two blocks, and an inventory of any size is as many tasks as it has pairs of them. With
    ``prune_by_time`` only pairs stay whose active periods share an hour that both have begun.
    """
    blocks = max(1, -(-df.count() // BLOCK))
    number, every_block = F.pmod(F.xxhash64("component_id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = df.select(*(F.col(c).alias(f"{c}_a") for c in df.columns), number.alias("_i"), every_block.alias("_j"))
    b = df.select(*(F.col(c).alias(f"{c}_b") for c in df.columns), every_block.alias("_i"), number.alias("_j"))
    auto = F.col("component_id_a") == F.col("component_id_b")
    intra = (F.col("network_a") == F.col("network_b")) & (F.col("station_a") == F.col("station_b"))
    place = [F.col(c) for c in ("lat_a", "lon_a", "lat_b", "lon_b")]
    out = a.join(b, ["_i", "_j"]).filter(intra | C.is_east_of(*place))
    if prune_by_time:
        hour = lambda c: F.date_trunc("hour", F.col(c))
        out = out.filter(F.greatest(hour("start_date_a"), hour("start_date_b")) < F.least(hour("end_date_a"), hour("end_date_b")))
    arc = F.when(intra, F.lit(0.0)).otherwise(C.arc_radians(*place))
    return out.select(
        "component_id_a", "component_id_b", "network_a", "network_b", "station_a", "station_b", "component_a", "component_b",
        F.concat("component_a", "component_b").alias("component_code_pair"),
        auto.alias("autocorrelation"),
        (intra & ~auto).alias("intracorrelation"),
        arc.alias("arc"),
        F.degrees(arc).alias("arcdistance"),
        (arc * C.EARTH_KM).alias("distance"),
        F.when(intra, F.lit(0.0)).otherwise(C.bearing(*place[2:], *place[:2])).alias("azimuth"),
        F.when(intra, F.lit(0.0)).otherwise(C.bearing(*place)).alias("backazimuth"),
    )


def choose_pairs(
    df: DataFrame,
    network_a=None, station_a=None, component_a=None, network_b=None, station_b=None, component_b=None, codes=None,
    include_auto: bool = False, include_intra: bool = False, only_auto: bool = False, only_intra: bool = False,
) -> DataFrame:
    """Pairs by either side, code and kind. Pairs of one component or station are left out
    unless included, or the only ones asked for; the two "only" exclude each other."""
    if only_auto and only_intra:
        raise ValueError("only_auto and only_intra exclude each other")
    sides = {"network_a": network_a, "station_a": station_a, "component_a": component_a, "network_b": network_b, "station_b": station_b, "component_b": component_b, "component_code_pair": codes}
    tests = [F.col(c).isin(list(v)) if v else None for c, v in sides.items()]
    if only_auto:
        tests.append(F.col("autocorrelation"))
    elif only_intra:
        tests.append(F.col("intracorrelation"))
    else:
        tests += [None if include_auto else ~F.col("autocorrelation"), None if include_intra else ~F.col("intracorrelation")]
    return df.filter(every(tests))


def cylindrical_pairs(df: DataFrame, with_backazimuth: bool = False) -> DataFrame:
    """For every pair of stations, the rotated codes with the component ids that each
    needs; ids of letters that a code doesn't need are null, codes without all are left out.
    On request with the backazimuth, the smallest of the pair's components'."""
    pick = [
        F.max(F.when(F.col(f"component_{side}") == letter, F.col(f"component_id_{side}"))).alias(f"{side}{letter}")
        for side in "ab"
        for letter in "ENZ"
    ]
    stations = df.filter(~F.col("autocorrelation") & ~F.col("intracorrelation")).groupBy("network_a", "station_a", "network_b", "station_b")
    wide = stations.agg(*pick, F.min("backazimuth").alias("backazimuth"))
    ids = [f"{s}{x}" for s in "ab" for x in "ENZ"]
    rows = []
    for code, (a1, a2, b1, b2) in CYLINDRICAL.items():
        used = {f"a{a1}", f"a{a2}", f"b{b1}", f"b{b2}"}
        rows.append(F.struct(F.lit(code).alias("code"), *((F.col(c) if c in used else F.lit(None).cast("long")).alias(c) for c in ids), every([F.col(c).isNotNull() if c in used else None for c in ids]).alias("whole")))
    out = wide.select("network_a", "station_a", "network_b", "station_b", "backazimuth", F.explode(F.array(*rows)).alias("r"))
    kept = ["network_a", "station_a", "network_b", "station_b", *["backazimuth"] * with_backazimuth]
    return out.filter("r.whole").select(*kept, F.col("r.code").alias("component_cylindrical_code_pair"), *(F.col(f"r.{c}") for c in ids))


def choose_cylindrical(df: DataFrame, ids_a: list[int], ids_b: list[int], codes: list[str] | None = None) -> DataFrame:
    """Rotated pairs by code and by any of the ids on either side."""
    any_of = lambda side, ids: F.arrays_overlap(F.array(*(F.col(f"{side}{x}") for x in "ENZ")), F.lit(ids).cast("array<bigint>"))
    both = ids_a + ids_b
    return df.filter(every([F.col("component_cylindrical_code_pair").isin(codes) if codes else None, F.coalesce(any_of("a", both), F.lit(False)), F.coalesce(any_of("b", both), F.lit(False))]))


def availability(present: DataFrame, total: int, by: str) -> DataFrame:
    """Percentage of windows with a chunk, to two digits, half to even."""
    return present.groupBy(by).agg(F.bround(F.count("*") * 100.0 / F.lit(total), 2).alias("percentage"))
