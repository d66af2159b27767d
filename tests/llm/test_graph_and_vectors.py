"""Near-duplicates, components, exact and approximate search."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillwave.llm import ann, components, neardup, topk
from stillwave.llm import vectors as searched

from .conftest import prose


def linked(rows, k, threshold):
    """Components by brute force over all pairs that share a shingle."""
    sets = {}
    for d, text in rows:
        w = (text or "").encode().lower().split()
        sets[d] = frozenset(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    where = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            where[g].append(d)
    for d, s in sets.items():
        for e, n in Counter(e for g in s for e in where[g] if e < d).items():
            if 100 * n >= threshold * (len(s) + len(sets[e]) - n):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("k", "threshold"), [(3, 85), (5, 80)])
def test_near_duplicates_of_documents(spark, docs, k, threshold):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, k, threshold).collect()}
    assert found == linked([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], k, threshold)


def test_chains_and_blocks(spark, monkeypatch):
    """A group of near copies, many pairs of which fall short, split over blocks of six."""
    rng = np.random.default_rng(3)
    base = prose(7, 150).split()
    rows = [(0, " ".join(base))]
    for d in range(1, 60):
        w = list(base)
        for at in rng.choice(150, rng.integers(1, 7), replace=False):
            w[at] = f"edit{rng.integers(0, 20)}"
        rows.append((1000 - d, " ".join(w)))
    for name, value in (("BUCKET_BLOCK", 6), ("GROUP_BLOCK", 6)):
        monkeypatch.setattr(neardup, name, value)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, 3, 85).collect()}
    expected = linked(rows, 3, 85)
    assert found == expected and 1 < len({c for _, c in expected.values()}) < 60


def test_near_duplicates_odd(odd, none):
    rows = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(odd).collect()]
    assert len(rows) == odd.count()
    assert (1, 0, 1, True) in rows and (2, 0, 2, True) in rows and (3, 0, 3, True) in rows and (8, 1, 8, True) in rows
    assert [r[2:] for r in rows if r[0] == 4] == [(4, True)] * 2 and [r[2:] for r in rows if r[0] == 5] == [(4, False)]
    assert [r[2:] for r in rows if r[0] is None] == [(None, True)] * 2
    assert neardup.near_duplicates(none).count() == 0


def test_repeated_ids(spark):
    """Rows of one id are one node; where rows are judged each, only their texts count."""
    a, b, c = prose(11, 80), prose(12, 80), prose(13, 80)
    near = a + " end"
    df = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    found = lambda *rows: Counter((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df(*rows), 3, 85).collect())
    assert found((1, a), (2, a), (2, b), (3, b)) == Counter([(1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False)])
    assert found((4, a), (2, near), (4, ""), (4, c), (9, c), (5, b), (5, None)) == Counter([(4, 2, False)] * 3 + [(2, 2, True), (9, 2, False), (5, 5, True), (5, 5, True)])
    left = lambda *rows: sorted(tuple(r) for r in neardup.keep_first(df(*rows), 3, 85).collect())
    assert left((1, a), (5, a), (5, c)) == [(1, a), (5, c)]
    assert left((2, b), (2, b), (2, c), (3, near), (3, a), (3, a), (7, "")) == sorted([(2, b), (2, c), (7, ""), min((3, near), (3, a), key=lambda r: spark_hash(spark, r[1]))])


def spark_hash(spark, text):
    return spark.range(1).select(F.xxhash64(F.lit(text)).alias("h")).first().h


def test_hot_keys(spark, monkeypatch):
    """Hubs, hot buckets and large classes take the other way of a join to the same rows."""
    base = prose(21, 120)
    rows = [(i, base) for i in range(30)] + [(100 + i, base.replace("the", f"edit{i}", 1)) for i in range(40)] + [(200 + i, prose(50 + i, 60)) for i in range(20)] + [(300, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(tuple(r) for r in neardup.near_duplicates(df, 3, 85).collect())
    monkeypatch.setattr("stillwave.llm.common.HOT_ROWS", 3)
    assert sorted(tuple(r) for r in neardup.near_duplicates(df, 3, 85).collect()) == plain
    assert {r[0]: r[1:3] for r in plain} == linked(rows, 3, 85)


def test_no_nested_loops(docs):
    plan = neardup.near_duplicates(docs)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000), (None, 3)] + [(7000, 7001 + i) for i in range(50)]
    parent = {x: x for e in edges for x in e if x is not None}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    nodes = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "a long, b long")
    got = [tuple(r) for r in components.connected_components(df).collect()]
    assert len(got) == len(nodes) and dict(got) == {x: root(x) for x in nodes}
    assert components.connected_components(df.filter("false")).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("*", *(F.lit(0).alias(c) for c in ("id", "score", "rank", "ids", "matrix", "dim", "query_id")))


def sample(seed=0, n=400, dim=64):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).round(3)
    x[10:20] = x[5]
    return [(i, v.tolist(), 0) for i, v in enumerate(x)]


ODD = [(900, None, 0), (950, [], 0), (1000, [None] * 64, 0), (1050, [float("nan")] * 64, 0), (1100, [float("inf")] + [0.0] * 63, 0), (None, [1.0] * 64, 0), (1150, [1.0, 2.0], 0), (1200, [0.0] * 64, 0)]


def test_top_k(spark):
    rows = sample() + ODD + [(3, sample()[3][1], 0)]
    df = vectors(spark, rows)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df, df.filter("vec_id % 50 = 0")).collect()}
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    for q, x in good:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in good if i != q and len(y) == len(x))[:5]
            assert [got.get((q, k + 1)) for k in range(len(best))] == [(i, -s) for s, i in best]
            assert (q, len(best) + 1) not in got
    empty = df.filter("false")
    assert topk.top_k(empty, empty).count() == 0 and topk.top_k(df, empty).count() == 0


def exact_products(rows, q):
    """Each row's score for the vector q, in Python's integers, held to a long."""
    whole = lambda v: [int(x) * 256 if abs(x) >= 2**53 else math.floor(256 * x) for x in v]
    return sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole(q[1]), whole(v), strict=True)))), i) for i, v, _ in rows if i != q[0] and len(v) == len(q[1]))


def test_top_k_of_any_size_over_blocks(spark, monkeypatch):
    """Small and large vectors, blocks of about 40 rows, and ids that are stored twice."""
    monkeypatch.setattr(searched, "ROWS", 40)
    rng = np.random.default_rng(8)
    rows = [(i, v, 0) for i, v, _ in sample(2, 300, 16)]
    rows += [(300 + i, (rng.standard_normal(16) * 10.0**e).tolist(), 0) for i, e in enumerate([5, 6, 8, 10, 14, 20, 200, 300])] + [(310, [2.0**21] + [0.0] * 15, 0)]
    rows += [(100, (rng.standard_normal(16)).tolist(), 0), (7, rows[7][1], 0)]
    df = vectors(spark, rows).repartition(3)
    for asked in ("vec_id % 50 = 0", "vec_id in (303, 306, 310)"):
        got = Counter((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, df.filter(asked)).collect())
        queries = [r for r in rows if (r[0] % 50 == 0 if "%" in asked else r[0] in (303, 306, 310))]
        assert got == Counter((q[0], k + 1, i, -s) for q in queries for k, (s, i) in enumerate(exact_products(rows, q)[:5]))


def test_own_and_repeated_ids(spark):
    """A query's own id never fills its ranks, and each row of a repeated query id has ranks
    of its own."""
    rows = [(0, v, 0) for _, v, _ in sample(3, 8, 8)] + [(1 + i, v, 0) for i, v, _ in sample(4, 30, 8)]
    df = vectors(spark, rows)
    for found in (topk.top_k(df, df.filter("vec_id = 0")), ann.nearest(df, df.filter("vec_id = 0"))):
        found = found.collect()
        assert Counter((r.rank) for r in found) == {k: 8 for k in range(1, 6)} and all(r.vec_id for r in found)
    one = df.filter("vec_id = 1")
    assert ann.nearest(df.limit(5).unionByName(one), one).count() == 5


def test_bound_is_one():
    rng = np.random.default_rng(5)
    q, c = rng.standard_normal((20, 64)), rng.standard_normal((50, 64))
    exact, last = q @ c.T, None
    for segments in (1, 4, 16, 64):
        bound = topk.statistics(q, segments) @ topk.statistics(c, segments).T
        assert (bound >= exact - 1e-9).all() and (last is None or (bound <= last + 1e-9).all())
        last = bound
    assert last == pytest.approx(exact)


def test_large_components_are_exact(spark):
    rows = [(i, [float(2**20 - i)] * 40 + [0.5 + i] * 24, 0) for i in range(30)]
    df = vectors(spark, rows)
    got = {r.rank: (r.vec_id, r.score) for r in topk.top_k(df, df.filter("vec_id = 0")).collect()}
    whole = [[int(256 * v) for v in x] for _, x, _ in rows]
    best = sorted((-sum(a * b for a, b in zip(whole[0], w, strict=True)), i) for i, w in enumerate(whole) if i)[:5]
    assert [got[k + 1] for k in range(5)] == [(i, -s) for s, i in best]


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(6).standard_normal((5, 32))
    assert ann.hadamard(ann.hadamard(x)) == pytest.approx(x) and (ann.hadamard(x) ** 2).sum(1) == pytest.approx((x**2).sum(1))


def exact_cosines(rows, k=5):
    good = [(i, np.array(v)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in good:
        if q % 50 == 0:
            out[q] = sorted((-float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))), i) for i, y in good if i != q and len(y) == len(x))[:k]
    return out


def test_neighbours(spark):
    rows = sample(1) + ODD
    df = vectors(spark, rows)
    expected = exact_cosines(rows)
    whole = defaultdict(list)
    for r in ann.nearest(df, df.filter("vec_id % 50 = 0"), probed=1.0).orderBy("query_id", "rank").collect():
        whole[r.query_id].append((-r.score, r.vec_id))
    for q, best in expected.items():
        assert [i for _, i in whole.get(q, [])] == [i for _, i in best] and [s for s, _ in whole.get(q, [])] == pytest.approx([s for s, _ in best], abs=1e-15)
    empty = df.filter("false")
    assert ann.nearest(empty, empty).count() == 0


def test_buckets_in_blocks(spark, monkeypatch):
    """Large buckets are dealt to blocks, and nothing but equal cells is ever joined."""
    rows = sample(5, 600, 8)
    df = vectors(spark, rows)
    plain = sorted(tuple(r) for r in ann.nearest(df, df.filter("vec_id % 50 = 0"), probed=0.3).collect())
    monkeypatch.setattr(searched, "ROWS", 7)
    found = ann.nearest(df, df.filter("vec_id % 50 = 0"), probed=0.3)
    assert sorted(tuple(r) for r in found.collect()) == plain
    narrow, asked = False, ann.vectors.located(df, "vec_id", "embedding", ann.placer(2, 0.5), False).withColumn("bar", F.lit(None).cast("double"))
    cells = ann.vectors.located(df, "vec_id", "embedding", ann.placer(2, None), narrow)
    plan = ann.vectors.meet(cells, asked, ann.vectors.blocks(cells), ann.maker(5), "double", narrow)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_recall(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    found = defaultdict(set)
    for r in ann.query(spark, sf).collect():
        found[r.query_id].add(r.vec_id)
    expected = exact_cosines(rows)
    assert sum(len(found[q] & {i for _, i in b}) for q, b in expected.items()) >= 0.9 * sum(map(len, expected.values()))


def clustered(seed, n, dim=64, centres=40, noise=0.05):
    rng = np.random.default_rng(seed)
    around = rng.standard_normal((centres, dim))
    return around[rng.integers(centres, size=n)] + noise * rng.standard_normal((n, dim))


def test_probes_follow_the_vectors():
    """Vectors in clusters need few probes, vectors without structure many; a plan finds the
    wanted part of its sample, and in a large table a bucket is told by a pair of axes."""
    rng = np.random.default_rng(9)

    def pairs(x):
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = unit[:100] @ unit.T
        near[np.arange(100), np.arange(100)] = -2
        at = np.argsort(-near, axis=1)[:, :5]
        return np.repeat(x[:100], 5, 0), x[at.ravel()]

    wide, tight = pairs(rng.standard_normal((2000, 64))), pairs(clustered(1, 2000))
    plans = {name: ann.chosen(*p, 2000, 40) for name, p in (("wide", wide), ("tight", tight))}
    assert plans["tight"].tables * plans["tight"].probes * 4 < plans["wide"].tables * plans["wide"].probes
    large = ann.chosen(*tight, 10**9, 10**7)
    assert large.hashes == 2 and large.tables * large.probes / 128**2 < plans["tight"].tables * plans["tight"].probes / 128
    for (q, x), plan in ((wide, plans["wide"]), (tight, plans["tight"]), (tight, large)):
        _, lies = ann.dealer(lambda dim, p=plan: p, False)(x)
        _, asks = ann.dealer(lambda dim, p=plan: p, True)(q)
        assert asks.shape == (500, plan.tables * plan.probes) and lies.shape == (500, plan.tables)
        met = (asks[:, :, None] == lies[:, None, :]).any((1, 2)).mean()
        assert ann.RECALL <= met


@pytest.mark.parametrize("hashes", [1, 2])
def test_neighbours_in_clusters(spark, monkeypatch, hashes):
    """Whole searches with either kind of bucket; a dimension that the sample lacks, and
    queries that find too few, meet all rows."""
    rows = [(i, v.tolist(), 0) for i, v in enumerate(clustered(2, 900, 32))] + [(1000 + 50 * i, [1.0, float(i)], 0) for i in range(8)] + [(2000, [1.0] * 7, 0)]
    df = vectors(spark, rows).repartition(3)
    if hashes == 2:
        monkeypatch.setattr(ann, "calibrated", lambda *_: {32: ann.Plan(2, 2, 4)})
    found = defaultdict(list)
    for r in ann.nearest(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    expected = {q: [i for _, i in b] for q, b in exact_cosines(rows).items()}
    assert all(len(found[q]) == len(b) for q, b in expected.items())
    assert all(found[q] == b for q, b in expected.items() if q >= 1000)
    if hashes == 1:
        assert sum(len(set(found[q]) & set(b)) for q, b in expected.items()) >= 0.9 * sum(map(len, expected.values()))


@pytest.mark.parametrize(("groups", "cells"), [(10_000, 100_000), (6, 0)])
def test_top_k_skips_blocks(spark, monkeypatch, groups, cells):
    """Of smooth vectors most blocks are never visited, and the result is whole; with few
    groups, neighbouring blocks share bounds, and with many codes these are joined."""
    monkeypatch.setattr(searched, "ROWS", 40)
    monkeypatch.setattr(searched, "CELLS", cells)
    monkeypatch.setattr(topk, "GROUPS", groups)
    rng = np.random.default_rng(11)
    x = np.cumsum(rng.standard_normal((1200, 64)), 1).round(3)
    x[100:220] = x[50]  # one code of more rows than a block has
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    df = vectors(spark, rows).repartition(3)
    asked, plain = [], topk.visits
    monkeypatch.setattr(topk, "visits", lambda *a: asked.append(plain(*a)) or asked[-1])
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df, df.filter("vec_id % 50 = 0")).collect()}
    whole = np.floor(256 * x).astype(np.int64)
    for q in range(0, 1200, 50):
        best = sorted((-s, i) for i, s in enumerate((whole @ whole[q]).tolist()) if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    visited, every = asked[-1].count(), 24 * len({r.grp for r in asked[-1].select("grp").distinct().collect()})
    assert len(asked) == 2 and asked[0].count() == 24 and visited < (0.5 if groups > 100 else 0.95) * every
