"""Sharding, licences, tokenizers, packing, toxicity and languages."""

import functools
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stillwave.llm import bpe, langid, licenses, packing, sharding, toxicity

from .conftest import prose

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
TEXTS = st.lists(st.sampled_from([*"abzAZ 019.,!?'é́ßİΣς\n\t\r\x0b\x85\x1c  　中🙂-_<|>", "'s", "'LL", "  ", "\n\n", "\n\n\n", " \n", "<|endoftext|>", "<|startoftext|>", "tion", " the"]), max_size=120).map("".join)

library = functools.cache(Tokenizer.from_file)


def shards(df):
    rows = df.toPandas()
    by = rows.groupby("shard")
    for _, s in by.slot:
        assert sorted(s) == list(range(len(s)))
    return rows, by["size"].sum()


def test_shards_of_documents(spark, sf, docs):
    rows, sizes = shards(sharding.query(spark, sf))
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    assert len(rows) == len(texts) and set(rows.doc_id) == set(texts)
    assert all(r["size"] == len(texts[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for _, r in rows.iterrows())
    largest = rows["size"].max()
    assert abs(sizes.reindex(range(40), fill_value=0) - rows["size"].sum() / 40).max() <= largest


def test_shards_of_one_text(spark):
    """A third of all rows and more are one text, and all of these one row."""
    df = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 2000, "same").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    rows, sizes = shards(sharding.shard(df, 40))
    assert len(rows) == 3000 and sizes.max() - sizes.min() <= 2 * rows["size"].max() + 2 * 0.005 * sizes.mean()


def test_groups_share_a_shard(spark):
    """Beside a text that fills several shards, groups of five equal texts stay together."""
    rows = [(i, f"{'word ' * 30}{i // 5}") for i in range(4000)] + [(4000 + i, "x" * 500) for i in range(3000)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 10).toPandas()
    assert (found[found.doc_id < 4000].groupby("text_crc32").shard.nunique() == 1).all()
    assert found[found.doc_id >= 4000].shard.nunique() > 1


def test_shards_odd(odd, none):
    rows, _ = shards(sharding.shard(odd, 4))
    assert len(rows) == odd.count() and rows[rows.doc_id == 1][["size", "text_crc32"]].values.tolist() == [[16, 0]]
    assert sharding.shard(none, 4).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(odd, 0)


@pytest.mark.parametrize("name, change", [
    ("MIT", lambda t: t), ("MIT", str.upper), ("MIT", lambda t: "Copyright (c) 2019 Some One\nCopyright 2020 Other\n\n" + t), ("MIT", lambda t: t.replace(",", " ,").replace("sublicense", "sub-licence").replace("\n", "\r\n")),
    ("BSD-3-Clause", lambda t: t.replace("“", '"').replace("copyright holder", "copyright owner").replace("COPYRIGHT HOLDER ", "COPYRIGHT OWNER ").replace("COPYRIGHT HOLDERS", "COPYRIGHT OWNERS")), (None, lambda t: t + " and more"),
])
def test_licence_texts(spark, name, change):
    text = change(dict(reversed(licenses.KNOWN))[name or "MIT"])
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().license == name


def test_holder_lines_and_entire_licences(spark):
    mit = licenses._MIT
    holders = ["Copyright Jane Doe 2020", "Copyright The Foo Authors", "Copyright: 2020 X", "Copyright <YEAR> <COPYRIGHT HOLDER>", "Copyright (c) 2020 X\nAll rights reserved."]
    wrapped = mit.replace("The above copyright notice", "The above\ncopyright notice").replace("OR COPYRIGHT HOLDERS", "OR\nCOPYRIGHT HOLDERS")
    shorter = wrapped.replace("copyright notice and this permission notice shall be", "")
    rows = [*((i, f"{h}\n\n{mit}", "MIT") for i, h in enumerate(holders)), (10, wrapped, "MIT"), (11, shorter, None), (12, "All rights reserved.", None)]
    rows += [(20 + i, f"Copyright The Foo Authors\n\n{t.upper()}", name) for i, (name, t) in enumerate(licenses.ENTIRE)]
    found = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, name string")).collect()}
    assert found == {i: name for i, _, name in rows}


def test_one_canonical_form_in_query_and_sql(spark, tmp_path):
    """Holders' lines of every kind before and in every known text: the SQL twin agrees on all, and
    each has the digest of the text without them."""
    holders = ["", "Copyright (c) 2020 X", "Copyright Jane Doe 2020", "Copyright: 2020 X", "/* © The Foo Authors", "Copyright The Foo Authors\nAll rights reserved.", "copyright notice of ours", "All rights reserved by us"]
    known = [*licenses.ENTIRE, *licenses.KNOWN]
    rows = [(100 * i + k, f"{h}\n\n{t.replace(chr(10), chr(13) + chr(10)) if k % 2 else t}") for i, (_, t) in enumerate(known) for k, h in enumerate(holders)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: tuple(r) for r in licenses.query(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    order = ["doc_id", "canonical_sha256", "license", "notices"]
    cursor = con.execute(licenses.SQL)
    names = [d[0] for d in cursor.description]
    assert {r[names.index("doc_id")]: tuple(r[names.index(c)] for c in order) for r in cursor.fetchall()} == found
    for i, (name, text) in enumerate(known):
        for k in range(6):
            assert found[100 * i + k][1:3] == (licenses.digest(text), name), (name, holders[k])
        assert all(found[100 * i + k][2] is None for k in (6, 7))


def names_holder(line):
    """Whether a lowered line names a holder or reserves all rights, by its first words."""
    line = line[len(line) - len(line.lstrip("".join(set(line) - set("abcdefghijklmnopqrstuvwxyz0123456789©(")))) :] if line else line
    while line[:1] == "(" and not re.match(r"\(c\)[ \t]*[0-9]", line):
        line = re.sub(r"^[^a-z0-9]", "", line)
        line = line.lstrip("".join(set(line) - set("abcdefghijklmnopqrstuvwxyz0123456789©(")))
    if line.startswith("©") or re.match(r"\(c\)[ \t]*[0-9]", line):
        return True
    if re.fullmatch(r"all[ \t]+rights[ \t]+reserved[^a-z0-9]*", line):
        return True
    rest = re.match(r"copyright[ \t:]+([^ \t:].*)", line, re.S)
    first = rest and re.match("[a-z0-9]*", rest[1])[0]
    return bool(rest) and not re.fullmatch(licenses._SENTENCE, first)


def canonical_words(text):
    """The canonical form word by word, written down apart from the operator's replacements."""
    words = []
    for line in text.lower().replace("\r", "\n").split("\n"):
        if names_holder(line):
            continue
        found = re.findall("[a-z0-9\x80-\U0010ffff]+", line)
        for old, new in licenses.EQUIVALENT:
            old, out = old.split(), []
            while found:
                n = len(old) if found[: len(old)] == old else 0
                out += new.split() if n else found[:1]
                found = found[n or 1 :]
            found = out
        words += found
    return " ".join(words)


def test_canonical_form_word_by_word(spark, docs):
    odd = ["Copyright Jane Doe\nCopyright holders of\n * Copyright: the\n-- all rights reserved.\nall rights reserved by\n((c) 3\n(x) copyright\tFoo\ncopyright\ncopyright : :", "licence licence licence\ncopyright owner copyright owner", "sub licence sub license, Centre-centre", "© 2020 Foo\n (c) 2021\nv v v https", "Copyright 2001\n\nwhilst\r\nwhilst"]
    given = spark.createDataFrame(list(enumerate(odd, 10**6)), "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    texts = {r.doc_id: r.text for r in given.collect()}
    found = {r.doc_id: r.canonical_sha256 for r in licenses.scan(given).collect()}
    assert found == {d: None if t is None else hashlib.sha256(canonical_words(t).encode()).hexdigest() for d, t in texts.items()}


def test_licence_lines_and_odd(spark, odd, none):
    df = spark.createDataFrame([(1, "Some words.\nReleased under the MIT License.\nlicensed under the apache licence, v 2.0"), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert rows[1].notices == "Apache-2.0,MIT" and rows[1].license is None
    assert rows[2].canonical_sha256 is None and rows[3].canonical_sha256 == hashlib.sha256(b"").hexdigest() and rows[3].license is None
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(none).count() == 0
    assert licenses.scan(df, known=[]).filter("license is not null").count() == 0


def test_licence_plan_is_native(spark, sf):
    plan = licenses.query(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_bpe_round_trip(text):
    words = library(WORD)
    ids = words.encode(text, add_special_tokens=False).ids
    n, as_text, decoded = bpe.chunk_encoder(WORD).encode(text)
    assert (n, as_text.decode()) == (len(ids), " ".join(map(str, ids)))
    assert decoded.decode() == words.decode(ids, skip_special_tokens=False)


@settings(max_examples=1000, deadline=None)
@given(TEXTS)
@example("\n\n<|endoftext|>")
@example("Hello.\n\n<|endoftext|>x")
@example("a\n\n<|endoftext|>\n\n<|endoftext|>\n\n")
@example("a <|endoftext|> b  <|endoftext|>\n<|endoftext|><|endoftext|> c")
def test_byte_encoder_agrees(text):
    ids = library(BYTE).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(bpe.byte_encoder(BYTE).encode(text), "<u4").tolist() == ids


def test_chunks_are_reused_and_joins_repaired():
    encoder = bpe.ChunkEncoder(WORD)
    shared = prose(5, 3000)
    for front in ("", "x", "other words before ", "é" * 700):
        text = front + shared
        assert [*map(int, encoder.encode(text)[1].split())] == Tokenizer.from_file(WORD).encode(text, add_special_tokens=False).ids
    assert encoder.reused > 2 * encoder.encoded
    assert bpe.cuts(b"") == [] and bpe.cuts(b"a")[-1] == 1


def test_bpe_odd(odd, none):
    rows = bpe.encode_documents(odd, "word_bpe_49k.json", with_ids=True).collect()
    library = Tokenizer.from_file(WORD)
    texts = {r.doc_id: r.text or "" for r in odd.collect() if r.doc_id is not None}
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id is not None:
            assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
    assert bpe.encode_documents(none, "word_bpe_49k.json").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 1024), max_size=200))
def test_first_fit_decreasing_against_a_plain_loop(sizes):
    room: list[int] = []
    expected = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if k == len(room):
            room.append(1024)
        room[k] -= sizes[i]
        expected[i] = k
    assert packing.first_fit_decreasing(sizes, 1024) == expected


def test_packing_is_whole(docs, odd, none):
    library = Tokenizer.from_file(BYTE)
    for df in (docs, odd):
        rows = packing.pack(df, "byte_bpe_50k.json").toPandas()
        texts = [(r.doc_id, np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")) for r in df.collect()]
        assert rows.length.sum() == sum(len(i) for _, i in texts)
        pieces = {(d, k, zlib.crc32(i[k : k + 1024].tobytes())) for d, i in texts if d is not None for k in range(0, len(i), 1024)}
        known = rows[rows.doc_id.notna()]
        assert set(zip(known.doc_id, known.start, known.ids_crc32, strict=True)) == pieces
        for _, s in rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
            assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 1024
    filled = packing.pack(docs, "byte_bpe_50k.json").groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.avg("n")).first()[0]
    assert filled > 0.95 * 1024
    assert packing.pack(none, "byte_bpe_50k.json").count() == 0


def test_ordinal_regression_shares_weights():
    rng = np.random.default_rng(1)
    x = (rng.random((4000, 3)) < 0.4).astype(float)
    z = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=4000)
    w, t = toxicity.regress(x, np.digitize(z, [0.0, 1.5, 3.0]), 4)
    assert w == pytest.approx([2, -1, 0], abs=0.25) and t == pytest.approx([0, 1.5, 3], abs=0.25)


def test_ordinal_gradient():
    """Weights found by the fit are a maximum of the penalised likelihood."""
    rng = np.random.default_rng(2)
    x, g = (rng.random((200, 2)) < 0.5).astype(float), rng.integers(0, 3, 200)
    w, t = toxicity.regress(x, g, 3)

    def value(w, t):
        cut = np.concatenate([[-40], t, [40]])
        s = lambda v: 1 / (1 + np.exp(-v))
        return np.log(s(cut[g + 1] - x @ w) - s(cut[g] - x @ w)).sum() - 0.05 * (w * w).sum() - 0.05 * np.log(np.diff(t)).sum() ** 2

    best = value(w, t)
    for d in (0.05, -0.05):
        assert value(w + [d, 0], t) < best and value(w + [0, d], t) < best and value(w, t + d) < best


def test_rare_insults_stay_beside_a_common_one():
    """A word of 30 toxic and no clean documents counts, whatever the strongest word has."""
    toxic = np.arange(4000) < 430
    documents = [{f"common{i % 7}", *(["insult"] if i < 400 else ["rare"] if i < 430 else [])} for i in range(4000)]
    assert toxicity.select(documents, toxic.astype(int)) == ["insult", "rare"]
    many = [{f"m{10 * (i // 30) + k}" for k in range(10)} if i < 900 else {f"common{i % 7}"} for i in range(8000)]
    found = toxicity.select(many, (np.arange(8000) < 900).astype(int))
    assert {f"m{k}" for k in range(300)} <= set(found)
    x = toxicity.presence(documents, ["insult", "rare"])
    dense, v = np.array([["insult" in d, "rare" in d] for d in documents], float), np.random.default_rng(3).random(4000)
    assert x @ np.array([2.0, 3.0]) == pytest.approx(dense @ [2.0, 3.0]) and x.T @ v == pytest.approx(dense.T @ v)


def test_words_at_the_end_of_long_texts_are_learned(spark):
    rows = [(i, f"q{chr(97 + i // 10)}{chr(97 + i % 10)} {prose(i, 9000)}" + " blorg" * (i < 40)) for i in range(80)]
    assert min(len(t) for _, t in rows) > 1 << 15
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") < 40).cast("int").alias("toxic")))
    assert model.weights["blorg"] > 0 and model.severity("you blorg") > 0.5


def test_toxicity_in_every_language(spark):
    """Insults of four languages of unequal share, learned from some documents and found in
    others; clean documents of all of them stay."""
    rng = random.Random(5)
    languages = {"en": (600, "scum moron"), "de": (250, "depp trottel"), "fr": (200, "crétin abruti"), "es": (120, "idiota imbécil")}
    rows = []
    for name, (n, insults) in languages.items():
        words = [f"{name}{a}{b}" for a in "aeiou" for b in "bcdfglmnrst"]
        for k in range(n):
            text = [rng.choice(words) for _ in range(60)]
            if k % 8 == 0:
                text[rng.randrange(60)] = rng.choice(insults.split())
            rows.append((len(rows), " ".join(text), name, int(k % 8 == 0), rng.random() < 0.6))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int, learned boolean")
    model = toxicity.fit(df.select("doc_id", "text"), df.filter("learned").select("doc_id", "toxic"))
    found = toxicity.score(df.filter("not learned"), model).join(df, "doc_id").toPandas()
    for name, some in found.groupby("lang"):
        assert some[some.toxic == 1].rejected.mean() >= 0.9 and some[some.toxic == 0].rejected.mean() == 0, name


def test_repeated_labels_and_ids(spark):
    """Labels that contradict each other, and rows that repeat an id, count once."""
    rows = [(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26)} some words" + " blorg" * (i < 40)) for i in range(160)]
    docs = spark.createDataFrame(rows + [(200, "blorg and more")] * 300, "doc_id long, text string")
    labels = [(i, int(i < 40)) for i in range(160)] + [(0, 0), (0, None)] * 20 + [(200, 0)] * 50
    given = spark.createDataFrame(labels, "doc_id long, toxic int")
    once = toxicity.fit(docs.dropDuplicates(["doc_id"]), spark.createDataFrame([(i, int(i < 40)) for i in range(160)] + [(200, 0)], "doc_id long, toxic int"))
    model = toxicity.fit(docs, given)
    assert model.weights == once.weights and model.weights["blorg"] > 0 and list(model.thresholds) == list(once.thresholds)


def test_toxicity(spark, docs, odd, none, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    planted = spark.createDataFrame([(1, "You IDIOT, a moron, scum, trash and a pathetic loser!"), (2, prose(9, 200))], "doc_id long, text string")
    assert {r.doc_id: r.rejected for r in toxicity.score(planted, model).collect()} == {1: True, 2: False}
    assert toxicity.score(odd, model).filter("severity is null").count() == 0 and toxicity.score(odd, model).count() == odd.count()
    assert toxicity.keep(odd, model).columns == odd.columns and toxicity.keep(none, model).count() == 0
    for empty in (labels.filter("false"), labels.filter("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert toxicity.score(docs, toxicity.fit(docs, empty)).filter("rejected").count() == 0


def test_language_masks_have_no_false_negative():
    counted = {f"l{k}": dict.fromkeys(np.random.default_rng(k).integers(0, 2**63, 300).tolist(), 5) for k in range(70)}
    model = langid.build(counted)
    for bit, name in enumerate(sorted(counted)):
        mask = model.masks(np.array(list(counted[name]), np.uint64))
        assert ((mask[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1).all()
    assert (model.false < 1e-3).all()


def test_language_counts_match_one_by_one():
    texts = [prose(k, 40) for k in range(5)] + ["", None, "É ß", "x" * 300_000]
    model = langid.build({"a": dict.fromkeys(np.concatenate([h for _, b in langid.pieces(texts[:3]) for h, _ in langid.grams(b)]).tolist(), 3)})
    found, total = model.counts(texts)
    for i, t in enumerate(texts):
        f, n = model.counts([t])
        assert (f[0] == found[i]).all() and n[0] == total[i]


def test_languages_held_out(spark, sf, docs, odd, none):
    rows = langid.query(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = rows[rows.held_out]
    assert len(rows) == docs.count() and (held.lang == held.lang_pred).mean() > 0.95 and rows.score.between(0, 1).all()
    assert set(rows.held_out) == {True, False} and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows.itertuples())
    model = langid.fit(docs)
    got = {r.doc_id: r.lang_pred for r in langid.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == got[7] == "und" and got[4] == "en"
    assert langid.predict(none, model).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(none)).collect()} == {"und"}


def test_languages_are_learned_from_whole_texts(spark):
    """What stands only behind the first 20,000 signs counts, and ties go to the first name."""
    rows = [(i, ("mmmm nnnn " if i % 2 else "pppp qqqq ") * 2500 + ("zoky vuda " if i % 2 else "hefi gabu ") * 400, "xx" if i % 2 else "aa") for i in range(20)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict(["zoky vuda", "hefi gabu"])[0] == ["xx", "aa"]
    same = langid.fit(spark.createDataFrame([(1, "abcd efgh", "b"), (2, "abcd efgh", "a"), (3, "abcd efgh", "b"), (4, "abcd efgh", "a")], "doc_id long, text string, lang string"))
    assert same.predict(["abcd"])[0] == ["a"]


def test_repeatable(spark, sf):
    first, second = (sorted(map(tuple, langid.query(spark, sf).collect())) for _ in range(2))
    assert first == second
    random.seed(0)
