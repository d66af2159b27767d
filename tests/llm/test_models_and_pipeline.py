"""The language model, the pipeline and the registry."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stillwave.llm import common, langid, lm, neardup, registry, toxicity

from .conftest import prose


def small_vocabulary():
    head = [(lm.END, 40), *((f"w{i}".encode(), 60 - i) for i in range(50))]
    ends = Counter()
    for w, c in head[1:]:
        ends[lm.spelling(w)] += c
    return lm.vocabulary(head, [(e, c, 5) for e, c in ends.most_common()], sum(c for _, c in head), len(head))


def test_probabilities_sum_to_one():
    v = small_vocabulary()
    network = lm.Network(v, lm.start_weights(v))
    h = np.random.default_rng(0).uniform(-1, 1, (3, lm.STATE)).astype(np.float32)
    for row in h:
        symbols = np.arange(v.learned + len(v.log_size))
        logs = network.logs(np.repeat(row[None], len(symbols), 0), symbols)
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-5)


def test_gradient_by_differences():
    v = small_vocabulary()
    rng = np.random.default_rng(1)
    weights = {k: x.astype(np.float64) for k, x in lm.start_weights(v).items()}
    x, y = rng.integers(0, v.learned + 3, (2, 6, 4))
    fresh = np.zeros((6, 4), bool)
    fresh[0], fresh[3, 1] = True, True
    h0 = np.zeros((4, lm.STATE))
    network = lm.Network(v, dict(weights))
    caught = {}
    network._descend = lambda g, n: caught.update(g)
    network.learn(x, fresh, y, h0)

    def loss(w):
        net = lm.Network(v, w)
        return -net.logs(net.states(x, fresh, h0).reshape(-1, lm.STATE).astype(np.float64), y.reshape(-1)).sum()

    for k in weights:
        at = tuple(int(rng.integers(0, s)) for s in weights[k].shape) if k != "table" else (int(x[2, 1]), 5)
        up, down = ({**weights, k: weights[k].copy()} for _ in range(2))
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        assert (loss(up) - loss(down)) / 2e-2 == pytest.approx(float(caught[k][at]), rel=0.05, abs=5e-3)


def test_lanes_and_windows_change_nothing():
    v = small_vocabulary()
    network = lm.Network(v, lm.start_weights(v))
    rng = np.random.default_rng(2)
    documents = [rng.integers(0, v.learned, n).astype(np.int32) for n in (1, 5, 200, 3, 77, 2, 400)]
    alone = [lm.score_all(network, [d])[0] for d in documents]
    assert lm.score_all(network, documents) == pytest.approx(alone, rel=1e-5)


def test_language_model(spark, sf, docs):
    rows = lm.query(spark, sf).toPandas().set_index("doc_id")
    words = {r.doc_id: [*r.text.encode().lower().split(), None] for r in docs.collect()}
    counts = Counter(w for d, ws in words.items() if zlib.crc32(str(d).encode()) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for d, ws in words.items():
        r = rows.loc[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 1)
    held = rows[rows.held_out]
    assert held.score.sum() > held.base_score.sum() and (rows.score < 0).all()


def test_every_training_document_trains_once(spark, docs, monkeypatch):
    fold = common.crc32_of(F.col("doc_id")) % 5 != 1
    seen, averaged = [], lm._averaged

    def watched(texts, *rest):
        seen.extend(r.text for r in texts.collect())
        return averaged(texts, *rest)

    monkeypatch.setattr(lm, "_averaged", watched)
    few = docs.limit(60)
    lm.score_documents(few, fold)
    assert sorted(seen) == sorted(r.text for r in few.filter(fold).collect())


def test_no_symbol_is_left_out_of_training():
    v = small_vocabulary()
    network, targets = lm.Network(v, lm.start_weights(v)), []
    learn = network.learn
    network.learn = lambda x, fresh, y, h, real=None: (targets.append(y[slice(None) if real is None else real].reshape(-1)), learn(x, fresh, y, h, real))[1]
    documents = [np.random.default_rng(i).integers(1, v.learned, 2003) for i in range(3)]
    assert lm.train_on(network, documents) == 6009
    assert sorted(np.concatenate(targets)) == sorted(np.concatenate(documents))
    assert all(np.isfinite(w).all() for w in network.w.values())


def test_base_doesn_t_depend_on_the_head(spark, sf, docs, monkeypatch):
    """Counts come from the broadcast head or from the join, and are the same."""
    fold = common.crc32_of(F.col("doc_id")) % 5 != 1
    few = docs.filter("doc_id < 60")
    rows = []
    for head in (1 << 17, 40, 0):
        monkeypatch.setattr(lm, "HEAD", head)
        rows.append(lm.score_documents(few, fold).toPandas().set_index("doc_id").sort_index())
    for other in rows[1:]:
        assert other.base_score.tolist() == pytest.approx(rows[0].base_score.tolist(), rel=1e-9)
        assert other.n_known.tolist() == rows[0].n_known.tolist()


def test_language_model_odd(odd, none):
    rows = lm.score_documents(odd, F.col("doc_id") % 2 == 0).toPandas()
    assert len(rows) == odd.count() and rows.score.notna().all()
    same = rows[rows.doc_id == 4]
    assert len(same) == 2 and np.ptp(same.score) < 1e-3 and rows[rows.doc_id == 1].n_tokens.tolist() == [1]
    assert lm.score_documents(none, F.lit(True)).count() == 0
    untrained = lm.score_documents(odd, F.lit(False)).toPandas()
    assert (untrained.base_score.abs() < 1e-9).all() and (untrained.n_known == 0).all() and (untrained.train_tokens == 0).all()


def written(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_pipeline_stages(spark, sf, docs, tmp_path):
    """Each stage, on what the one before kept, against its rule applied row by row."""
    (_, toxic), (_, language), (_, near), (_, pack) = corpus_pipeline.STAGES
    one = written(toxic(spark, docs, sf), tmp_path / "1")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(one) == {r.doc_id for r in docs.collect() if model.severity(r.text) < toxicity.REJECT}
    two = written(language(spark, one, sf), tmp_path / "2")
    filter_ = langid.fit(one)
    predicted = {r.doc_id: filter_.predict([r.text]) for r in one.collect()}
    assert ids(two) == {d for d, (n, s) in predicted.items() if n[0] != "und" and s[0] >= corpus_pipeline.LEAST_LANGUAGE}
    three = written(near(spark, two, sf), tmp_path / "3")
    assert ids(three) == {r.doc_id for r in neardup.near_duplicates(two, 5, 80).collect() if r.kept}
    assert one.columns == two.columns == three.columns == docs.columns
    four = pack(spark, three, sf)
    assert ids(four) == ids(three)
    assert four.count() == corpus_pipeline.run(spark, sf).count()


def test_pipeline_odd(spark, odd, none, sf):
    left = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, left, sf)
        if name != "packing":
            assert out.columns == odd.columns
            left = common.cut(out)
        assert stage(spark, none, sf).count() == 0
    assert [r.doc_id for r in left.collect()].count(4) == 1 and {1, 2, 3, 7} & {r.doc_id for r in left.collect()} == set()


def test_clean_documents_stay(spark, sf):
    clean = spark.createDataFrame([(10_000 + i, prose(100 + i, 80), "en", "s", 1) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(clean)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = common.cut(stage(spark, docs, sf))
        assert docs.filter("doc_id >= 10000").count() == 30, name


def test_registry(spark):
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert numbers == list(range(1, 14)) and set(registry.ORACLES) <= set(registry.QUERIES)


def test_severities_by_brute_force(spark, sf, docs):
    """The query's severities for the given table, from the labelled texts anew: dense rows of
    words, evidence word by word, and plain gradient steps on the same likelihood."""
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic is not null").collect()
    grade_of = {}
    for r in labels:
        grade_of[r.doc_id] = max(grade_of.get(r.doc_id, 0), r.toxic)
    assert len(grade_of) < toxicity.LABELLED  # so all of them are learned from
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    bags = {d: frozenset(re.findall(toxicity._WORD.pattern, t.lower())) if t else frozenset() for d, t in texts.items()}
    learned = sorted({(g, tuple(sorted(bags[d]))) for d, g in grade_of.items() if d in bags})
    grade, n = np.array([g for g, _ in learned]), len(learned)
    evidence = {}
    tested = 0
    for w in sorted({w for _, b in learned for w in b}):
        has = np.array([w in b for _, b in learned])
        if has.sum() < toxicity.LEAST_DOCUMENTS:
            continue
        tested += 1
        score = 0.0
        for rows, expected in ((has, has.mean()), (~has, 1 - has.mean())):
            for kind in (grade > 0, grade == 0):
                c = (rows & kind).sum()
                score += 2 * c * math.log(c / (kind.sum() * expected)) if c else 0.0
        evidence[w] = score
    least = toxicity.EVIDENCE + 2 * math.log(max(1, tested))
    words = sorted((w for w in evidence if evidence[w] >= least), key=lambda w: (-evidence[w], w))
    assert words
    x = np.array([[w in b for w in words] for _, b in learned], float)
    # Two grades: one threshold t and P(toxic) = s(wx - t); Adam as its authors state it.
    theta = np.concatenate([np.zeros(len(words)), [math.log((grade == 0).sum() + 1) - math.log((grade > 0).sum() + 1)]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, 601):
        w, t = theta[:-1], theta[-1]
        p = 1 / (1 + np.exp(-(x @ w - t)))
        error = (grade > 0) - p
        g = np.concatenate([x.T @ error - 0.1 * w, [-error.sum()]]) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    found = {r.doc_id: (r.severity, r.rejected) for r in toxicity.query(spark, sf).collect()}
    assert set(found) == set(texts)
    for d, b in bags.items():
        severity = 1 / (1 + math.exp(-(sum(theta[k] for k, w in enumerate(words) if w in b) - theta[-1])))
        assert found[d][0] == pytest.approx(severity, abs=1e-4) and found[d][1] == (found[d][0] >= toxicity.REJECT)
