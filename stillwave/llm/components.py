"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwave.llm import common

#: Rounds after which an unfinished run is an error; the need grows with the logarithm of
#: the longest path.
ROUNDS = 60
#: Tasks that a node's links are dealt to when its minimum is joined back to them.
SALTS = 8


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _joined(links: DataFrame, low: DataFrame, node: str, other: str) -> DataFrame:
    """Links with their node's minimum."""
    salted = low.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return links.withColumn("_salt", F.pmod(F.hash(other), F.lit(SALTS))).join(salted, [node, "_salt"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``component``) for every node of an edge between different nodes;
    ``component`` is the smallest node reachable. Edges with a null end and loops say
    nothing; without other edges the result is empty.

    Large-star links a node's larger neighbours to the smallest node around it, small-star
    links its smaller neighbours and itself to the smallest of these. Both are a minimum by
    node, combined before the shuffle, and a join back, in which a node's links are dealt to
    SALTS tasks, each with its minimum; no neighbourhood is ever gathered. Each round is cut
    from its lineage.
    """
    ends = edges.select(F.col(a).alias("_a"), F.col(b).alias("_b")).filter("_a <> _b")
    now = common.cut(ends.select(F.greatest("_a", "_b").alias("u"), F.least("_a", "_b").alias("v")).distinct())
    state = _state(now)
    for _ in range(ROUNDS if state[0] else 0):
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("m", "x").alias("m"))
        large = _joined(both.filter("y > x"), low, "x", "y").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _joined(large, low, "u", "v").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = common.cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
