"""Sharding by sampled splitters, with DataFrame functions only.

Rows are put in the order of (hash of the text, id, row number). Splitters cut this order
into ranges of about equal bytes: keys are sampled with a probability in proportion to
their size, and the quantiles of the sample become the boundaries. The exact bytes of every
range are then counted, and ranges that turn out overfull (a large group of equal texts, an
unlucky sample) are sampled again by themselves and subdivided. Each range is a bounded
piece of work for one task; its running totals plus the totals of the ranges before it
place every row, so no task ever sees a whole shard or a whole group.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stillwave.llm import common

#: Draws for each range; the boundaries' error falls with the root of it.
DRAWS = 32
#: Ranges for each shard, and the most rows for which one range is meant.
RANGES_PER_SHARD = 8
ROWS_PER_RANGE = 1_000_000
#: A group of equal texts stays in one shard if it takes at most this part of a shard, and at
#: most one range's share.
GROUP_SHARE = 0.005
#: Times that overfull ranges are sampled again.
ROUNDS = 6
#: A range is overfull beyond so many times its share.
OVERFULL = 2.0

LOWEST = -(2**63)


def _longs(values: list[int]) -> F.Column:
    """A literal array; as one string it costs one call and folds to a constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _search(splitters: list[tuple[int, int, int]]) -> F.Column:
    """Number of splitters at or below a row's key, by binary search."""
    if not splitters:
        return F.lit(0)
    hashes, ids, rows = (_longs([s[k] for s in splitters]) for k in range(3))
    strides = F.lit([1 << k for k in reversed(range(len(splitters).bit_length()))])

    def at_or_below(i):
        h, d, r = (F.element_at(a, i) for a in (hashes, ids, rows))
        return (h < F.col("_h")) | (
            (h == F.col("_h")) & ((d < F.col("_d")) | ((d == F.col("_d")) & (r <= F.col("_r"))))
        )

    def step(low, stride):
        up = low + stride.cast("int")
        return F.when((up <= len(splitters)) & at_or_below(F.least(up, F.lit(len(splitters)))), up).otherwise(low)

    return F.aggregate(strides, F.lit(0), step)


def _quantiles(draws: list[tuple[float, tuple[int, int, int]]], pieces: int) -> list[tuple[int, int, int]]:
    """Keys that cut weighted draws into so many pieces."""
    draws = sorted(draws, key=lambda d: d[1])
    total, so_far, found = sum(w for w, _ in draws), 0.0, []
    for weight, key in draws:
        if so_far + weight >= total * (len(found) + 1) / pieces and len(found) + 1 < pieces:
            found.append(key)
        so_far += weight
    return found


def _drawn(rows: DataFrame, rate: float, seed: int) -> list[tuple[float, tuple[int, int, int]]]:
    """A Poisson sample: a row of size s is drawn with probability min(1, s * rate), and
    stands for max(1, s * rate) draws. Its expected length is the rate times all bytes."""
    chance = F.least(F.lit(1.0), F.col("_size") * F.lit(rate))
    u = F.pmod(F.xxhash64("_h", "_d", "_r", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    taken = rows.filter(u < chance).select("_h", "_d", "_r", (F.col("_size") * F.lit(rate)).alias("w"))
    return [(max(1.0, r.w), (r["_h"], r["_d"], r["_r"])) for r in taken.collect()]


def shard(df: DataFrame, shards: int, text: str = "text", id: str = "doc_id", overhead: int = 16, seed: int = 7) -> DataFrame:
    """All rows of ``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0
    in each shard), so that the shards' bytes are near equal.

    A row's size is its text's UTF-8 bytes plus ``overhead``. Returned are ``id``, ``size``,
    ``text_crc32`` (unsigned, of the UTF-8 bytes), ``shard`` and ``slot``.

    Rows of equal text lie next to each other in the order, and share a shard if together
    they take at most GROUP_SHARE of one and at most one range; larger groups are split by id
    and row. A null text
    has no bytes, so its size is ``overhead`` and its CRC 0; a null id sorts first. Repeated
    rows each get a slot of their own. An empty table gives an empty result. Other columns
    are left out, so their names can't clash.

    Only the driver's copies of the splitters and of the ranges' totals grow, by one entry
    for RANGES_PER_SHARD-th parts of a shard or ROWS_PER_RANGE rows.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(
        F.col(id).alias("_id"),
        (F.octet_length(content) + F.lit(overhead)).cast("long").alias("_size"),
        F.crc32(F.encode(content, "UTF-8")).alias("_crc"),
        F.xxhash64(F.col(text)).alias("_h"),
        F.coalesce(F.col(id).cast("long"), F.lit(LOWEST)).alias("_d"),
        F.monotonically_increasing_id().alias("_r"),
    )
    rows = common.cut(rows)
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
    ranges = max(RANGES_PER_SHARD * shards, -(-n // ROWS_PER_RANGE))
    share = max(1.0, total / ranges)

    # The first splitters stand before whole groups, so that only overfull ranges cut a group.
    draws = _drawn(rows, ranges * DRAWS / max(1, total), seed)
    splitters = sorted({(k[0], LOWEST, LOWEST) for k in _quantiles(draws, ranges)})
    for again in range(ROUNDS + 1):
        placed = rows.withColumn("_range", _search(splitters))
        counted = placed.groupBy("_range").agg(F.sum("_size").alias("bytes"), F.count("*").alias("rows")).collect()
        over = {r["_range"]: r.bytes for r in counted if r.bytes > OVERFULL * share and r.rows > 1}
        if not over or again == ROUNDS:
            break
        more: list[tuple[int, int, int]] = []
        draws = _drawn(placed.filter(F.col("_range").isin(list(over))), ranges * DRAWS / max(1, total), seed + 1 + again)
        within: dict[int, list] = {r: [] for r in over}
        for weight, key in draws:
            within[bisect.bisect_right(splitters, key)].append((weight, key))
        for r, bytes_ in over.items():
            for key in _quantiles(within[r], max(2, round(bytes_ / share))):
                # Cut before a whole group, unless the range itself begins there or within it.
                start = (key[0], LOWEST, LOWEST)
                more.append(start if not r or start > splitters[r - 1] else key)
        if not set(more) - set(splitters):
            break
        splitters = sorted({*splitters, *more})

    before_bytes, before_rows, b, c = [], [], 0, 0
    by_range = {r["_range"]: r for r in counted}
    for r in range(len(splitters) + 1):
        before_bytes.append(b)
        before_rows.append(c)
        if r in by_range:
            b, c = b + by_range[r].bytes, c + by_range[r]["rows"]

    in_order = Window.partitionBy("_range").orderBy("_h", "_d", "_r")
    group = Window.partitionBy("_range", "_h")
    placed = (
        placed.withColumn("_end", F.element_at(_longs(before_bytes), F.col("_range") + 1) + F.sum("_size").over(in_order))
        .withColumn("_place", F.element_at(_longs(before_rows), F.col("_range") + 1) + F.row_number().over(in_order) - 1)
        .withColumn("_start", F.col("_end") - F.col("_size"))
        .withColumn("_whole", F.sum("_size").over(group))
        .withColumn("_first", F.min("_start").over(group))
    )
    small = F.col("_whole") <= F.lit(int(min(GROUP_SHARE * total / shards, share)))
    twice_middle = F.when(small, 2 * F.col("_first") + F.col("_whole")).otherwise(F.col("_start") + F.col("_end"))
    where = F.expr(f"_twice_middle * {shards}L div {2 * max(1, total)}L")
    placed = common.cut(
        placed.withColumn("_twice_middle", twice_middle).select(
            "_id", "_size", "_crc", "_place", F.least(where, F.lit(shards - 1).cast("long")).cast("int").alias("shard")
        )
    )
    firsts = {r["shard"]: r.first for r in placed.groupBy("shard").agg(F.min("_place").alias("first")).collect()}
    starts = _longs([firsts.get(s, 0) for s in range(shards)])
    return placed.select(
        F.col("_id").alias(id),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        "shard",
        (F.col("_place") - F.element_at(starts, F.col("shard") + 1)).cast("long").alias("slot"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    return shard(common.documents(spark, sf_dir), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
