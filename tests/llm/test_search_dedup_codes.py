"""Ranked search, exact duplicates and vector codes against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stillwave.llm import codes, exactdup, ranked

from .conftest import prose


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# Exact duplicates


def duplicates(rows):
    """(id, keep_id, group_size, kept, digest) by brute force; ids are unique."""
    by = {}
    for d, t in rows:
        by.setdefault(lowered(t), []).append(d)
    return sorted((d, max(by[lowered(t)]), len(by[lowered(t)]), d == max(by[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest()) for d, t in rows)


def test_exact_duplicates_of_documents(spark, sf, docs):
    found = exactdup.query(spark, sf)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, found.collect())) == duplicates([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_refinement_tells_near_misses_apart(spark):
    """Equal lengths, equal prefixes, other letters' cases, accents, and a third in one group."""
    long = prose(3, 400)
    rows = [(1, "Same"), (2, "sAME"), (3, "same "), (4, "É"), (5, "é"), (6, long + "a"), (7, long + "b"), (8, long.upper() + "B"), (9, None), (10, ""), (11, "x" * 70 + "1"), (12, "x" * 70 + "2")]
    rows += [(100 + i, "HOT" if i % 2 else "hot") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, exactdup.groups(df, digests=True).collect())) == duplicates(rows)
    found = {r.doc_id: r.text_sha256 for r in exactdup.groups(df).collect()}
    assert found[3] is None and found[1] == found[2] is not None  # "same " has a length of its own


def test_a_full_filter_only_hashes_more(spark, monkeypatch):
    monkeypatch.setattr(exactdup, "WORDS", 1)
    rows = [(i, f"text {i % 700}") for i in range(900)]
    assert sorted(map(tuple, exactdup.groups(spark.createDataFrame(rows, "doc_id long, text string"), digests=True).collect())) == duplicates(rows)


def test_exact_duplicates_odd(odd, none):
    found = exactdup.groups(odd, carry=("score", "_id")).collect()
    assert len(found) == odd.count() and all(r.score == "x" and r._id == "x" for r in found)
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.keep_id for r in by[4] + by[5]} == {5} and [r.group_size for r in by[4]] == [3, 3]
    assert {r.keep_id for r in by[1] + by[2]} == {2} and by[6][0].kept and sum(r.kept for r in found if r.group_size == 3 and r.keep_id == 2) == 1
    assert exactdup.groups(none).count() == 0
    again = exactdup.groups(odd.select("doc_id", "text").unionByName(odd.select("doc_id", "text")))
    assert again.filter("kept").count() == len({lowered(r.text) for r in odd.collect()})


# Ranked search


def searched(docs, items, k=50):
    """(item_id, rank, doc_id, score) by the formula, document by document; ids are unique."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))
    bags = {d: Counter(split(t)) for d, t in docs}
    bags = {d: b for d, b in bags.items() if b}
    total, holding = sum(sum(b.values()) for b in bags.values()), Counter(t for b in bags.values() for t in b)
    out = []
    for item, text in items:
        scores = []
        for d, bag in bags.items():
            m = 100 - 50 + (50 * sum(bag.values()) * len(bags)) // total
            score = sum(math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * holding[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in set(split(text)) if bag[t])
            if score > 0:
                scores.append((-score, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def test_ranked_search_of_documents(spark, sf, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(map(tuple, ranked.query(spark, sf).collect())) == searched([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], items)


@pytest.mark.parametrize("small", [False, True])
def test_ranked_ties_shards_and_blocks(spark, monkeypatch, small):
    """Equal texts tie over many shards, whose order of ids isn't that of the rows; items are
    searched in several passes."""
    if small:
        monkeypatch.setattr(ranked, "SHARD", 7)
        monkeypatch.setattr(ranked, "TERMS", 20)
    docs = [((i * 37) % 400, prose(i % 23, 30) if i % 5 else "same words of the Heand ouer") for i in range(400)] + [(400, None), (401, ""), (402, "?!")]
    items = [(i, prose(50 + i, 12)) for i in range(9)] + [(9, None), (10, " "), (11, "unheard words WORDS heand"), (12, "nothingofit")]
    found = ranked.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), k=10)
    assert sorted(map(tuple, found.collect())) == searched(docs, items, 10)


def test_shard_skips_documents(monkeypatch):
    rng = np.random.default_rng(5)
    size, number = 20_000, 30
    weights = np.arange(1, number + 1) ** 3
    held = [np.sort(rng.choice(size, max(5, size // (t + 2) ** 2), replace=False)) for t in range(number)]
    docs, term = np.concatenate(held), np.repeat(np.arange(number), [len(h) for h in held])
    tf, m = rng.integers(1, 5, len(docs)), rng.integers(60, 200, size)
    shard = ranked.Shard(docs, term, tf, m, weights)
    scores = np.bincount(docs, ranked.impact(weights[term], tf, m[docs]).astype(float), size).astype(np.int64)
    order = np.lexsort((np.arange(size), -scores))[:20]
    at, best, scored = shard.best(list(range(number)), 20)
    assert at.tolist() == order.tolist() and best.tolist() == scores[order].tolist()
    assert scored < 0.3 * len(np.unique(docs))
    at, _, _ = ranked.Shard(docs[:0], term[:0], tf[:0], m, weights).best([1, 2], 5)
    assert len(at) == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aZ09 ./:@[`{~\x7f\x80éİ中\n"))
def test_terms_whole_and_in_pieces(text):
    expected = [t.encode() for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))]
    assert [t for some in ranked.terms(text) for t in some] == expected
    whole, ranked.PIECE = ranked.PIECE, 3
    try:
        assert [t for some in ranked.terms(text) for t in some] == expected
    finally:
        ranked.PIECE = whole


def test_ranked_odd(spark, odd, none):
    items = spark.createDataFrame([(1, "heand ouer", "x"), (1, "heand ouer", "x"), (None, "word", "y"), (2, None, "y")], "item_id long, text string, rank string")
    found = ranked.search(odd, items).collect()
    ones = [r for r in found if r.item_id == 1]
    assert len(ones) == 2 * 5 and {r.doc_id for r in ones} == {4, 5, 6, None} and sorted(r.rank for r in ones) == sorted([1, 2, 3, 4, 5] * 2)
    assert [(r.doc_id, r.rank) for r in found if r.item_id is None] == [(8, 1)]
    assert ranked.search(none, items).count() == 0 and ranked.search(odd, items.filter("false")).count() == 0


# Vector codes


def coded(rows, rounds=6):
    """(vec_id, code, error, label_error, codebooks) by plain integers; ids are unique."""
    kept = sorted((i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v))
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    width = len(kept[0][1]) // 8
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in kept[:16]] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v, p: min((far(part(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        groups = {}
        for _, v, _ in kept:
            for p in range(8):
                groups.setdefault((p, best(v, p)[1]), []).append(part(v, p))
        for (p, k), members in groups.items():
            books[p][k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    found = [(i, [best(v, p) for p in range(8)], label) for i, v, label in kept]
    errors = Counter()
    for _, b, label in found:
        errors[label] += sum(d for d, _ in b)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((i, "".join(f"{k:02x}" for _, k in b), sum(d for d, _ in b), errors[label]) for i, b, label in found), digest


def as_rows(codes_df):
    labels = Counter()
    rows = codes_df.collect()
    for r in rows:
        labels[r.label] += r.error
    return sorted((r.vec_id, r.code, r.error, labels[r.label]) for r in rows)


def test_codes_of_embeddings(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    expected, digest = coded(rows)
    assert sorted(tuple(r) for r in codes.query(spark, sf).collect()) == [(*r, digest) for r in expected]


@pytest.mark.parametrize("n", [5, 60])
def test_codes_of_odd_vectors(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i * 7 % 101, [float(x) for x in rng.integers(-3, 3, 16) / 4096 * (1 if i % 3 else 700)], None if i % 4 else i % 3) for i in range(n)]
    rows += [(200, None, 1), (201, [1.0, None] * 8, 1), (202, [math.nan] + [0.0] * 15, 1), (203, [math.inf] * 16, None), (204, [-math.inf] * 16, 2), (205, [], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in ("code", "error", "_dim", "_v", "_id", "_x", "n", "place")})
    found, books = codes.compress(df.repartition(3), carry=("label",))
    expected, digest = coded(rows)
    assert as_rows(found) == expected and codes.books_digest(books) == digest
    back = {r.vec_id: r.vector for r in codes.decode(found, books).collect()}
    whole = {i: np.floor(4096 * np.array(v)) for i, v, _ in rows[:n]}
    assert all(((whole[i] - np.array(back[i]) * 4096) ** 2).sum() == e for i, _, e, _ in expected)


def test_codes_of_nothing_repeats_and_huge(spark):
    schema = "vec_id long, embedding array<double>, label int"
    found, books = codes.compress(spark.createDataFrame([], schema))
    assert found.count() == 0 and books is None
    rows = [(1, [0.5] * 8, 1)] * 40 + [(None, [0.25] * 8, None)] * 2 + [(2, [1e300] * 8, 1), (3, [0.5] * 7, 1)]
    found, books = codes.compress(spark.createDataFrame(rows, schema))
    kept = found.collect()
    assert len(kept) == 43 and books.shape == (8, 16, 1) and all(r.error >= 0 for r in kept)
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([(1, [0.5] * 7, 1)], schema))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.integers(1, 16), st.integers(1, 9), st.integers(0, 10**6), st.sampled_from([2, 50, 10**6]))
def test_partial_distances_find_the_nearest(rows, entries, width, seed, spread):
    rng = np.random.default_rng(seed)
    x, book = rng.integers(-spread, spread, (rows, width)), rng.integers(-spread, spread, (entries, width))
    far = ((x[:, None] - book[None]) ** 2).sum(2)
    entry, error, _ = codes.nearest(x, book)
    assert entry.tolist() == far.argmin(1).tolist() and error.tolist() == far.min(1).tolist()


def test_partial_distances_save_work():
    rng = np.random.default_rng(1)
    book = rng.integers(-1000, 1000, (16, 8)) * np.array([1, 1, 1, 50, 1, 1, 1, 1])
    x = book[rng.integers(0, 16, 3000)] + rng.integers(-50, 50, (3000, 8))
    assert codes.nearest(x, book)[2] < 0.5 * 3000 * 16 * 8
