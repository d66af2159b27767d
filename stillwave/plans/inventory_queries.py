"""Components, pairs and their filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwave.functions import columns as C
from stillwave.operators import inventory as I
from stillwave.plans import bindings as B
from stillwave.plans.window_queries import ntz

PLANS = B.Plans()

_COMPONENT = "component_id, network, station, component, lat, lon, start_date, end_date"
_PAIR = "component_id_a, component_id_b, component_code_pair"


@PLANS.add("src5_inventory", f"WITH {B.COMPONENTS_SQL} SELECT {_COMPONENT} FROM component")
def src5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.components(spark, sf_dir)


@PLANS.add("src6_channel_groups", f"WITH {B.COMPONENTS_SQL} SELECT component, count(*) AS n, min(station) AS first_station FROM component GROUP BY component")
def src6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.components(spark, sf_dir).groupBy("component").agg(F.count("*").alias("n"), F.min("station").alias("first_station"))


@PLANS.add(
    "flt1_components",
    f"""WITH {B.COMPONENTS_SQL} SELECT {_COMPONENT} FROM component WHERE network IN ('ASIA', 'EUROPE') AND component IN ('Z', 'N')
AND TIMESTAMP '2013-06-01' <= end_date AND start_date <= TIMESTAMP '2014-01-01'""",
)
def flt1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.components(B.components(spark, sf_dir), networks=["ASIA", "EUROPE"], codes=["Z", "N"], start=ntz("2013-06-01"), end=ntz("2014-01-01"))


@PLANS.add("jn1_pairs", f"WITH {B.PAIRS_SQL} SELECT {_PAIR}, autocorrelation, intracorrelation FROM pair")
def jn1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.pairs(B.components(spark, sf_dir)).select(*_PAIR.split(", "), "autocorrelation", "intracorrelation")


@PLANS.add("jn2_pairs_pruned", f"WITH {B.PAIRS_SQL} SELECT {_PAIR} FROM pair WHERE date_trunc('hour', both_begun) < date_trunc('hour', one_ended)")
def jn2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.pairs(B.components(spark, sf_dir), prune_by_time=True).select(*_PAIR.split(", "))


@PLANS.add(
    "sc1_distances",
    f"WITH {B.PAIRS_SQL} SELECT {_PAIR}, round(degrees(arc), 6) + 0.0 AS arcdistance, round(arc * 6371.0, 6) + 0.0 AS distance, round(azimuth, 6) + 0.0 AS azimuth, round(backazimuth, 6) + 0.0 AS backazimuth FROM pair",
)
def sc1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.pairs(B.components(spark, sf_dir)).select(*_PAIR.split(", "), *(C.rounded(F.col(c)).alias(c) for c in ("arcdistance", "distance", "azimuth", "backazimuth")))


@PLANS.add(
    "sc2_east_west",
    f"""WITH {B.COMPONENTS_SQL} SELECT a.station AS a, b.station AS b, a.lon > b.lon OR (a.lon = b.lon AND a.lat > b.lat) AS east FROM component a, component b
WHERE a.component = 'Z' AND b.component = 'Z' AND a.station <> b.station""",
)
def sc2(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = B.components(spark, sf_dir).filter("component = 'Z'")
    a, b = (z.select(F.col("station").alias(k), F.col("lat").alias(f"lat_{k}"), F.col("lon").alias(f"lon_{k}")) for k in "ab")
    both = a.join(b, F.col("a") != F.col("b"))
    return both.select("a", "b", C.is_east_of(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")).alias("east"))


@PLANS.add("sc3_pair_kinds", f"WITH {B.PAIRS_SQL} SELECT autocorrelation, intracorrelation, count(*) AS n FROM pair GROUP BY ALL")
def sc3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.pairs(B.components(spark, sf_dir)).groupBy("autocorrelation", "intracorrelation").agg(F.count("*").alias("n"))


@PLANS.add("flt8_pairs_filtered", f"""WITH {B.PAIRS_SQL} SELECT {_PAIR} FROM pair WHERE network_a = 'ASIA' AND component_code_pair IN ('ZZ', 'ZN') AND NOT autocorrelation""")
def flt8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.choose_pairs(I.pairs(B.components(spark, sf_dir)), network_a=["ASIA"], codes=["ZZ", "ZN"], include_intra=True).select(*_PAIR.split(", "))


@PLANS.add("flt8_only_intra", f"WITH {B.PAIRS_SQL} SELECT {_PAIR} FROM pair WHERE intracorrelation")
def flt8_intra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.choose_pairs(I.pairs(B.components(spark, sf_dir)), only_intra=True).select(*_PAIR.split(", "))


_WIDE = f"""{B.PAIRS_SQL}, wide AS (SELECT station_a, station_b, {", ".join(f"max(CASE WHEN component_{s} = '{x}' THEN component_id_{s} END) AS {s}{x}" for s in "ab" for x in "ENZ")}
FROM pair WHERE NOT one_station GROUP BY station_a, station_b), cylindrical AS ({" UNION ALL ".join(
    f"SELECT station_a, station_b, '{code}' AS component_cylindrical_code_pair, "
    + ", ".join((f"{s}{x}" if f"{s}{x}" in {f"a{w[0]}", f"a{w[1]}", f"b{w[2]}", f"b{w[3]}"} else "CAST(NULL AS BIGINT)") + f" AS {s}{x}" for s in "ab" for x in "ENZ")
    + " FROM wide"
    for code, w in I.CYLINDRICAL.items()
)})"""


@PLANS.add("jn3_cylindrical_pairs", f"WITH {_WIDE} SELECT * FROM cylindrical")
def jn3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cylindrical_pairs(I.pairs(B.components(spark, sf_dir))).drop("network_a", "network_b")


_ANY = lambda s: f"({s}E IN (1, 2, 3, 7, 8, 9) OR {s}N IN (1, 2, 3, 7, 8, 9) OR {s}Z IN (1, 2, 3, 7, 8, 9))"


@PLANS.add("flt9_cylindrical_filtered", f"WITH {_WIDE} SELECT * FROM cylindrical WHERE component_cylindrical_code_pair IN ('RR', 'ZR') AND {_ANY('a')} AND {_ANY('b')}")
def flt9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.cylindrical_pairs(I.pairs(B.components(spark, sf_dir)))
    return I.choose_cylindrical(found, [1, 2, 3], [7, 8, 9], ["RR", "ZR"]).drop("network_a", "network_b")


@PLANS.add("jn18_pairs_of_cylindrical", f"""WITH {_WIDE}, used AS (SELECT station_a, station_b FROM cylindrical WHERE component_cylindrical_code_pair = 'TT')
SELECT {_PAIR} FROM pair p WHERE EXISTS (SELECT 1 FROM used u WHERE u.station_a = p.station_a AND u.station_b = p.station_b)""")
def jn18(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = I.pairs(B.components(spark, sf_dir))
    used = I.cylindrical_pairs(pairs).filter("component_cylindrical_code_pair = 'TT'").select("station_a", "station_b")
    return pairs.join(used, ["station_a", "station_b"], "left_semi").select(*_PAIR.split(", "))


@PLANS.add("jn19_component_days", f"WITH {B.COMPONENTS_SQL}, {B.SPANS_SQL} SELECT component_id, timespan_id FROM component, span WHERE component = 'Z'")
def jn19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.components(spark, sf_dir).filter("component = 'Z'").crossJoin(F.broadcast(B.spans_of_events(spark, sf_dir))).select("component_id", "timespan_id")


@PLANS.add("jn21_override", """SELECT c_custkey, CASE WHEN c_nationkey IN (1, 4) THEN 'override' ELSE 'default' END AS params FROM customer WHERE c_nationkey NOT IN (2, 3)""")
def jn21(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    excluded, special = (spark.createDataFrame([(k,) for k in ks], "c_nationkey int") for ks in ((2, 3), (1, 4)))
    kept = c.join(F.broadcast(excluded), "c_nationkey", "left_anti")
    plain = kept.join(F.broadcast(special), "c_nationkey", "left_anti").select("c_custkey", F.lit("default").alias("params"))
    return plain.unionByName(kept.join(F.broadcast(special), "c_nationkey", "left_semi").select("c_custkey", F.lit("override").alias("params")))


@PLANS.add("jn22_rejected_lookup", f"""WITH {B.PAIRS_SQL} SELECT {_PAIR}, component_id_a < component_id_b AS reversed FROM pair WHERE NOT one_station AND least(component_id_a, component_id_b) = 3""")
def jn22(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.choose_pairs(I.pairs(B.components(spark, sf_dir)))
    return p.filter(F.least("component_id_a", "component_id_b") == 3).select(*_PAIR.split(", "), (F.col("component_id_a") < F.col("component_id_b")).alias("reversed"))


@PLANS.add("ag18_distinct", f"WITH {B.COMPONENTS_SQL} SELECT DISTINCT network, station FROM component")
def ag18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.components(spark, sf_dir).select("network", "station").distinct()


@PLANS.add("ag19_uniform", f"WITH {B.COMPONENTS_SQL} SELECT network, count(DISTINCT component) = 3 AS whole, count(DISTINCT start_date) = 1 AS one_start FROM component GROUP BY network")
def ag19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.components(spark, sf_dir).groupBy("network").agg((F.countDistinct("component") == 3).alias("whole"), (F.countDistinct("start_date") == 1).alias("one_start"))
