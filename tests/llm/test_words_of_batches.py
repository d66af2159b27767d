"""The language model reads words by whole batches, and as each text alone gives them."""

import pickle
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa

from stillwave.llm import common, lm

PARTS = ["a", "B", "é", "İ", "😀", "\x00", "\x1c", "\x85", "\xa0", " ", " ", "\t", "\n", "\x0b", "\x0c", "\r", ".", "!", "'", "Zz"]


def odd_texts():
    rng = random.Random(5)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(12))) for _ in range(3000)]
    return [*texts, None, "", " ", "\n\n", "a" * 700, " b" * 700]


def test_words_and_spellings_are_those_of_each_text(monkeypatch):
    monkeypatch.setattr(lm, "PORTION", 500)
    texts, found = odd_texts(), []
    for some in lm.portions(pa.array(texts)):
        words, starts = lm.words_and_ends(some)
        assert lm.spellings(words).to_pylist() == [lm.spelling(w) for w in words.to_pylist()]
        assert len(starts) == len(some) + 1
        found += [words.slice(a, b - a).to_pylist() for a, b in zip(starts, starts[1:], strict=False)]
    assert found == [[*common.ascii_words(t), lm.END] for t in texts]
    assert list(lm.portions(pa.array([], pa.string()))) == []


def vocabulary(texts, head):
    counts = Counter(w for t in texts for w in [*common.ascii_words(t), lm.END])
    ends, kinds = Counter(), Counter()
    for w in filter(None, counts):
        ends[lm.spelling(w)] += counts[w]
        kinds[lm.spelling(w)] += 1
    return lm.vocabulary(counts.most_common(head), [(e, c, kinds[e]) for e, c in ends.most_common()], sum(counts.values()), len(counts))


def test_places_and_rare_words():
    texts = odd_texts()
    v = pickle.loads(pickle.dumps(vocabulary(texts, 40)))
    head = {w: k for k, w in enumerate(v.words.to_pylist())}
    places, starts, rare = lm.Reader(v).read(pa.array(texts))
    words = [w for t in texts for w in [*common.ascii_words(t), lm.END]]
    assert places.tolist() == [head[w] if w in head else -1 - v.endings.get(lm.spelling(w), lm.SPELLINGS) for w in words]
    assert rare.to_pylist() == [w for w in words if w not in head]
    assert [len(d) for d in lm.Reader(v).documents(pa.array(texts))] == [b - a for a, b in zip(starts, starts[1:], strict=False)]


class WordByWord(dict):
    """As the query looked words up before: in Python, one by one."""

    def __init__(self, v):
        super().__init__((w, k) for k, w in enumerate(v.words.to_pylist()))
        self.v = v

    def __missing__(self, word):
        return -1 - self.v.endings.get(lm.spelling(word), lm.SPELLINGS)

    def read(self, text):
        words = [*common.ascii_words(text), lm.END]
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def test_reading_is_cheaper_than_word_by_word():
    rng = random.Random(7)
    known = ["".join(rng.choices("aeioubcdrst", k=rng.randrange(2, 9))) for _ in range(60_000)]
    texts = [" ".join(rng.choices(known, k=500)) for _ in range(1000)]
    v, column = vocabulary(texts, 20_000), pa.array(texts)
    reader, before = lm.Reader(v), WordByWord(v)
    assert np.concatenate([before.read(t) for t in texts]).tolist() == reader.read(column)[0].tolist()

    def seconds(run):
        took = []
        for _ in range(3):
            began = time.process_time()
            run()
            took.append(time.process_time() - began)
        return min(took)

    assert seconds(lambda: reader.read(column)) < 0.8 * seconds(lambda: [before.read(t.as_py()) for t in column])
