"""Scores of a gated recurrent language model.

A small GRU reads a document word by word; its softmax is factored, first over classes of
words and then over the words of one class. Frequent words stand in classes of their own by
frequency, and their probabilities within the class are learned. All others, unknown ones
included, fall into classes by spelling (last letters and marks), within which a word's
probability follows from its count in the whole training corpus. The probabilities of all
known words and of one unknown word a class sum to one.

Training is truncated backpropagation in numpy: tasks train on their own documents from the
same weights, the weights are averaged, and so on for a few rounds. Every training document
is trained on once, in the round that its hash gives; all counts are of all training
documents. Scoring carries the state across windows, from the first word of a
document to its end.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwave.llm import common

#: Words whose probability within a class is learned, and their classes.
LEARNED, LEARNED_CLASSES = 320, 12
#: Classes by spelling; what isn't among the most frequent endings shares one more.
SPELLINGS = 31
#: Frequent words whose counts every task holds; the counts of others are joined.
HEAD = 1 << 17
#: Size of the state, steps of a window, and documents that run side by side.
STATE, STEPS, STREAMS, TRAIN_STREAMS = 16, 24, 384, 128
#: Tokens that are trained on or scored together, whole documents; it bounds a task's memory.
TOKENS = 1_500_000
#: Bytes of texts whose words are told apart together, whole documents.
PORTION = 1 << 22
#: Rounds of averaging; each trains on its own part of the training documents.
ROUNDS = 3
RATE, CLIP = 0.01, 1.0
#: Averages that reach the driver.
AVERAGES = 8

END = b""
_MARKS = b".,;:!?|)(\"'*#$%&"


def spelling(word: bytes) -> bytes:
    """Last two bytes before any marks, and one mark if there are some."""
    bare = word.rstrip(_MARKS)
    return bare[-2:] + b"." * (len(bare) < len(word))


def spellings(words: pa.Array) -> pa.Array:
    """The same for an array of words, a binary one."""
    bare = pc.ascii_rtrim(words.cast(pa.string(), safe=False), _MARKS.decode()).cast(pa.binary())
    marked = pc.if_else(pc.less(pc.binary_length(bare), pc.binary_length(words)), b".", b"")
    return pc.binary_join_element_wise(pc.binary_slice(bare, -2), marked, b"")


def portions(texts: pa.Array) -> Iterator[pa.Array]:
    """``texts`` in slices of at most PORTION bytes, or of one text."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(texts):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + PORTION, "right")))
        yield texts.slice(first, last - first)
        first = last


def words_and_ends(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, the empty one after each text as its end; and where each
    text's begin, with the end of the last. They are the words of ``common.ascii_words``."""
    lowered = pc.ascii_trim_whitespace(pc.ascii_lower(texts.fill_null("")))
    # What follows the last space is empty, and so is the only part of an empty text.
    spaced = pc.if_else(pc.greater(pc.binary_length(lowered), 0), pc.binary_join_element_wise(lowered, "", " "), lowered)
    found = pc.ascii_split_whitespace(spaced)
    return found.flatten().cast(pa.binary()), found.offsets.to_numpy()


@dataclass
class Vocabulary:
    """What counts alone decide: symbols, classes, and constants of every head word.

    Symbols 0 to ``learned`` - 1 are the learned words by class (the document's end is one),
    then follow the spelling classes.
    """

    words: pa.Array  # of the head
    symbol: np.ndarray  # by head word
    log_count: np.ndarray  # log10(c + 0.5), by head word
    bounds: list[int]  # of the learned classes, in symbols
    endings: dict[bytes, int]
    log_size: np.ndarray  # log10 of the spelling classes' sums
    class_prior: np.ndarray
    word_prior: np.ndarray
    tokens: int
    distinct: int

    @property
    def learned(self) -> int:
        return self.bounds[-1]

    @property
    def classes(self) -> int:
        return len(self.bounds) - 1 + len(self.log_size)


def vocabulary(head: list[tuple[bytes, int]], endings: list[tuple[bytes, int, int]], tokens: int, distinct: int) -> Vocabulary:
    """From the HEAD most frequent words with counts, each ending's count of tokens and
    words, and the totals; ``head`` and ``endings`` are in falling order."""
    counts = dict(head)
    learned = [END] + [w for w, _ in head if w != END][: LEARNED - 1]
    learned.sort(key=lambda w: (-counts.get(w, 0), w))
    mass = np.cumsum([np.sqrt(counts.get(w, 0) + 1) for w in learned])
    inner = np.searchsorted(mass, mass[-1] * np.arange(1, LEARNED_CLASSES) / LEARNED_CLASSES)
    bounds = sorted({0, len(learned), *(int(b) for b in inner if 0 < b < len(learned))})
    named = {e: k for k, (e, _, _) in enumerate(endings[:SPELLINGS])}
    sums = np.zeros((SPELLINGS + 1, 2))
    for e, c, v in endings:
        sums[named.get(e, SPELLINGS)] += (c, v)
    for w in learned:  # they have left their spelling class
        if w != END and w in counts:
            sums[named.get(spelling(w), SPELLINGS)] -= (counts[w], 1)
    sums = np.maximum(sums, 0)
    size = sums[:, 0] + 0.5 * (sums[:, 1] + 1)
    symbol_of = {w: k for k, w in enumerate(learned)}
    words = [END, *(w for w, _ in head if w != END)]
    symbol = np.array([symbol_of[w] if w in symbol_of else len(learned) + named.get(spelling(w), SPELLINGS) for w in words], np.int32)
    c = np.array([counts.get(w, 0) for w in words], float)
    of_learned = np.array([counts.get(w, 0) + 0.5 for w in learned])
    by_class = np.concatenate([[of_learned[s:e].sum() for s, e in zip(bounds, bounds[1:], strict=False)], size])
    return Vocabulary(
        pa.array(words, pa.binary()), symbol, np.log10(c + 0.5), bounds, named, np.log10(size),
        np.log(by_class / by_class.sum()), np.log(of_learned), tokens, distinct,
    )


class Reader:
    """Words to head places; a rarer word to -1 - its spelling class."""

    def __init__(self, v: Vocabulary):
        self.v, self.endings = v, pa.array(list(v.endings), pa.binary())

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Head places or classes of the words and ends of all texts, where each text's begin,
        and the rare words."""
        words, starts = words_and_ends(texts)
        places = pc.index_in(words, self.v.words).fill_null(-1).to_numpy().copy()
        at = np.flatnonzero(places < 0)
        rare = words.take(pa.array(at))
        places[at] = -1 - pc.index_in(spellings(rare), self.endings).fill_null(SPELLINGS).to_numpy()
        return places, starts, rare

    def symbols(self, places: np.ndarray) -> np.ndarray:
        return np.where(places >= 0, self.v.symbol[np.maximum(places, 0)], self.v.learned - 1 - places).astype(np.int32)

    def documents(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Each text's symbols."""
        for some in portions(texts):
            places, starts, _ = self.read(some)
            yield from np.split(self.symbols(places), starts[1:-1])


def _sizes(v: Vocabulary) -> dict[str, tuple[int, ...]]:
    return {
        "table": (v.learned + len(v.log_size), 3 * STATE), "gates": (STATE, 2 * STATE), "new": (STATE, STATE),
        "classes": (STATE, v.classes), "class_bias": (v.classes,), "words": (STATE, v.learned), "word_bias": (v.learned,),
    }


def start_weights(v: Vocabulary) -> dict[str, np.ndarray]:
    """Small random weights; the biases make the untrained model one of plain frequencies."""
    rng = np.random.default_rng(20240303)
    w = {k: (rng.standard_normal(s) * (0.3 if k == "table" else 0.2)).astype(np.float32) for k, s in _sizes(v).items()}
    w["table"][:, :STATE] -= 1.0  # slow updates at first
    w["classes"] *= 0.1
    w["words"] *= 0.1
    w["class_bias"], w["word_bias"] = v.class_prior.astype(np.float32), v.word_prior.astype(np.float32)
    return w


class Network:
    """A GRU whose input is a symbol, with a class-factored softmax."""

    def __init__(self, v: Vocabulary, weights: dict[str, np.ndarray]):
        self.v, self.w = v, weights
        class_of = np.repeat(np.arange(len(v.bounds) - 1), np.diff(v.bounds))
        # Of two bytes, as numpy sorts those by their digits.
        self.class_of = np.concatenate([class_of, len(v.bounds) - 1 + np.arange(len(v.log_size))]).astype(np.int16)
        self.slopes = [np.zeros(sum(x.size for x in weights.values()), weights["table"].dtype) for _ in range(2)]
        self.steps = 0

    def states(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each of the symbols x (step, stream); where ``fresh`` is set, a
        document begins and the state before is zero. ``keep`` gets what the way back needs:
        the states before, the gates, the states let through, and the proposed ones."""
        # Streams are laid side by side in memory, so that each gate is one block of numbers.
        gates, new = -np.ascontiguousarray(self.w["gates"].T), np.ascontiguousarray(self.w["new"].T)
        inputs = np.ascontiguousarray(self.w["table"].take(x, axis=0).transpose(0, 2, 1))
        room = lambda rows, steps: np.empty((steps, rows, x.shape[1]), inputs.dtype)
        out, begins = room(STATE, len(x)), fresh.any(1)
        # Without a way back, all steps use the same room.
        kept = len(x) if keep is not None else 1
        zrs, rhs, cs, d = room(2 * STATE, kept), room(STATE, kept), room(STATE, kept), room(STATE, 1)[0]
        first = h = np.ascontiguousarray(h.T)
        for t in range(len(x)):
            if begins[t]:
                h = h * ~fresh[t]
            a, k = inputs[t], t % kept
            zr = np.matmul(gates, h, out=zrs[k])
            zr -= a[: 2 * STATE]
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            rh = np.multiply(zr[STATE:], h, out=rhs[k])
            c = np.matmul(new, rh, out=cs[k])
            c += a[2 * STATE :]
            np.tanh(c, out=c)
            np.subtract(c, h, out=d)
            np.multiply(d, zr[:STATE], out=d)
            h = np.add(h, d, out=out[t])
        if keep is not None:
            before = np.concatenate([first[None], out[:-1]])
            for t in np.flatnonzero(begins):
                before[t] *= ~fresh[t]
            keep += [before, zrs, rhs, cs]
        return np.ascontiguousarray(out.transpose(0, 2, 1))

    def _large(self, kind: str, bias: str) -> bool:
        """Whether a logit could leave the range of exponentials. A state is within -1 and 1,
        so the weights tell."""
        return float((np.abs(self.w[kind]).sum(0) + np.abs(self.w[bias])).max()) > 60

    def _logits(self, h: np.ndarray, w: np.ndarray, b: np.ndarray, large: bool) -> np.ndarray:
        """The logits, if need be less the largest one."""
        logits = h @ w
        logits += b
        if large:
            logits -= logits.max(1, keepdims=True)
        return logits

    def logs(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural logs of the probabilities of the symbols y (for a spelling class, of the
        class alone) after the states h."""
        k = self.class_of[y]
        order, parts = self._by_class(k)
        h, y, k = h.take(order, axis=0), y[order], k[order]
        logits = self._logits(h, self.w["classes"], self.w["class_bias"], self._large("classes", "class_bias"))
        out = logits[np.arange(len(y)), k]
        sums = np.exp(logits, out=logits) @ np.ones(logits.shape[1], logits.dtype)
        large = self._large("words", "word_bias")
        for rows, words in parts:
            logits = self._logits(h[rows], self.w["words"][:, words], self.w["word_bias"][words], large)
            out[rows] += logits[np.arange(len(logits)), y[rows] - words.start]
            sums[rows] *= np.exp(logits, out=logits) @ np.ones(logits.shape[1], logits.dtype)
        logs = np.empty(len(y))
        logs[order] = out.astype(np.float64) - np.log(sums.astype(np.float64))
        return logs

    def _by_class(self, k: np.ndarray) -> tuple[np.ndarray, list[tuple[slice, slice]]]:
        """An order by class; and there, for every learned class of several words that occurs,
        its rows and its words."""
        order = np.argsort(k, kind="stable")
        ends = np.cumsum(np.bincount(k, minlength=len(self.v.bounds)))[: len(self.v.bounds) - 1].tolist()
        parts = zip([0, *ends], ends, self.v.bounds, self.v.bounds[1:], strict=False)
        return order, [(slice(a, b), slice(s, t)) for a, b, s, t in parts if b > a and t - s > 1]

    def _errors(self, h: np.ndarray, w: np.ndarray, b: np.ndarray, y: np.ndarray, real: np.ndarray | None, large: bool) -> np.ndarray:
        """Slopes of the loss by the logits: the probabilities, less one at y."""
        p = self._logits(h, w, b, large)
        np.exp(p, out=p)
        p *= 1 / (p @ np.ones(p.shape[1], p.dtype))[:, None]
        p[np.arange(len(y)), y] -= 1
        if real is not None:
            p *= real[:, None]
        return p

    def learn(self, x: np.ndarray, fresh: np.ndarray, y: np.ndarray, h0: np.ndarray, real: np.ndarray | None = None) -> np.ndarray:
        """One window of truncated backpropagation; returns the last state. Where ``real``
        is given, targets outside it fill up a stream and teach nothing."""
        keep: list = []
        hs, begins = self.states(x, fresh, h0, keep), fresh.any(1)
        n = y.size
        k = self.class_of[y.reshape(-1)]
        order, parts = self._by_class(k)
        flat, target, k = hs.reshape(-1, STATE).take(order, axis=0), y.reshape(-1)[order], k[order]
        taught = None if real is None else real.reshape(-1)[order]
        p = self._errors(flat, self.w["classes"], self.w["class_bias"], k, taught, self._large("classes", "class_bias"))
        ones = np.ones(n, p.dtype)
        g = {"classes": flat.T @ p, "class_bias": ones @ p, "words": np.zeros_like(self.w["words"]), "word_bias": np.zeros_like(self.w["word_bias"])}
        d_sorted = p @ self.w["classes"].T
        large = self._large("words", "word_bias")
        for rows, words in parts:
            w = self.w["words"][:, words]
            q = self._errors(flat[rows], w, self.w["word_bias"][words], target[rows] - words.start, None if real is None else taught[rows], large)
            g["words"][:, words] = flat[rows].T @ q
            g["word_bias"][words] = ones[rows] @ q
            d_sorted[rows] += q @ w.T
        place = np.empty_like(order)
        place[order] = np.arange(n)
        d_out = np.ascontiguousarray(d_sorted.take(place, axis=0).reshape(hs.shape).transpose(0, 2, 1))
        # What doesn't depend on later steps is computed for all steps at once.
        h, zr, rh, c = keep
        z, r = zr[:, :STATE], zr[:, STATE:]
        by_d, by_rh = np.empty((len(x), 3, *z.shape[1:]), z.dtype), np.empty((len(x), 2, *z.shape[1:]), z.dtype)
        rest = np.subtract(1, z, out=by_d[:, 1])
        np.multiply(1 - c * c, z, out=by_d[:, 0])
        np.multiply((c - h) * z, rest, out=by_d[:, 2])
        np.multiply(h * r, 1 - r, out=by_rh[:, 0])
        by_rh[:, 1] = r
        # Slopes by the proposed state and, past the update gate, by the state before; by the
        # two gates; and, through the reset gate, by the state before: all to be summed up.
        d_in = np.empty((len(x), 5, *z.shape[1:]), d_out.dtype)
        one = np.eye(STATE, dtype=d_out.dtype)
        back = np.concatenate([one, self.w["gates"], one], 1)
        d_next = np.zeros_like(d_out[0])
        for t in reversed(range(len(x))):
            d, step = d_out[t], d_in[t]
            d += d_next
            np.multiply(d, by_d[t], out=step[:3])
            np.multiply(self.w["new"] @ step[0], by_rh[t], out=step[3:])
            d_next = back @ step[1:].reshape(4 * STATE, -1)
            if begins[t]:
                d_next *= ~fresh[t]
        d_gates = d_in[:, 2:4].reshape(len(x), 2 * STATE, -1)
        g["gates"] = np.matmul(h, d_gates.transpose(0, 2, 1)).sum(0)
        g["new"] = np.matmul(rh, d_in[:, 0].transpose(0, 2, 1)).sum(0)
        d_rows = np.empty((*x.shape, 3 * STATE), d_in.dtype)
        d_rows[..., : 2 * STATE] = d_gates.transpose(0, 2, 1)
        d_rows[..., 2 * STATE :] = d_in[:, 0].transpose(0, 2, 1)
        symbols = x.reshape(-1).astype(np.int16)
        order = np.argsort(symbols, kind="stable")
        symbols = symbols[order]
        first = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
        g["table"] = np.zeros_like(self.w["table"])
        g["table"][symbols[first]] = np.add.reduceat(d_rows.reshape(n, -1).take(order, axis=0), first, axis=0)
        self._descend(g, n if real is None else int(real.sum()))
        return hs[-1]

    def _descend(self, g: dict[str, np.ndarray], n: int) -> None:
        """One step of Adam, for all weights laid end to end."""
        self.steps += 1
        x = np.concatenate([g[k].reshape(-1) for k in self.w])
        norm = np.sqrt(float(x @ x)) / n
        x *= np.float32(min(1.0, CLIP / max(norm, 1e-12)) / n)
        rate = RATE * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        m, s = self.slopes
        m += np.float32(0.1) * (x - m)
        s += np.float32(0.001) * (x * x - s)
        flat = np.concatenate([w.reshape(-1) for w in self.w.values()]) - np.float32(rate) * m / (np.sqrt(s) + np.float32(1e-8))
        parts = np.split(flat, np.cumsum([w.size for w in self.w.values()])[:-1])
        self.w = {k: part.reshape(w.shape) for (k, w), part in zip(self.w.items(), parts, strict=True)}


def train_on(network: Network, documents: list[np.ndarray]) -> int:
    """Trains on documents of symbols laid end to end and cut into equal streams, the last
    of which are filled up; returns how many symbols there were."""
    if not documents:
        return 0
    end = network.v.symbol[0]
    y = np.concatenate(documents)
    x = np.concatenate([[end], y[:-1]])
    fresh = np.zeros(len(y), bool)
    fresh[np.cumsum([0, *map(len, documents[:-1])])] = True
    streams = max(1, min(TRAIN_STREAMS, len(y) // (40 * STEPS)))
    steps, tokens = -(-len(y) // streams), len(y)
    filled = lambda a, v: np.concatenate([a, np.full(streams * steps - tokens, v, a.dtype)]).reshape(streams, steps).T
    x, y, fresh, real = filled(x, end), filled(y, end), filled(fresh, True), filled(np.ones(tokens, bool), False)
    h = np.zeros((streams, STATE), np.float32)
    for t in range(0, steps, STEPS):
        part = real[t : t + STEPS]
        if part.any():
            h = network.learn(x[t : t + STEPS], fresh[t : t + STEPS], y[t : t + STEPS], h, None if part.all() else part)
    return tokens


def score_all(network: Network, documents: list[np.ndarray]) -> np.ndarray:
    """Sum of the natural logs for each document of symbols. Streams run side by side, each
    through several documents; a document's state is carried from window to window."""
    if not documents:
        return np.empty(0)
    streams = min(STREAMS, len(documents))
    # The longest document goes first, each to the lane with the least so far.
    heap = [(0, lane) for lane in range(streams)]
    lanes: list[list[int]] = [[] for _ in range(streams)]
    for d in sorted(range(len(documents)), key=lambda i: (-len(documents[i]), i)):
        load, lane = heapq.heappop(heap)
        lanes[lane].append(d)
        heapq.heappush(heap, (load + len(documents[d]), lane))
    # Longer lanes first, so that those still running are always the first ones.
    order = sorted(heap, key=lambda x: (-x[0], x[1]))
    loads, lanes = np.array([load for load, _ in order]), [lanes[lane] for _, lane in order]
    steps, end = int(loads[0]), network.v.symbol[0]
    y, of = np.full((steps, streams), end, np.int32), np.full((steps, streams), -1, np.int32)
    fresh = np.zeros((steps, streams), bool)
    for lane, docs in enumerate(lanes):
        at = 0
        for d in docs:
            n = len(documents[d])
            y[at : at + n, lane], of[at : at + n, lane], fresh[at, lane] = documents[d], d, True
            at += n
    x = np.concatenate([np.full((1, streams), end, np.int32), y[:-1]])
    x[fresh] = end
    total, h = np.zeros(len(documents)), np.zeros((streams, STATE), np.float32)
    for t in range(0, steps, STEPS):
        on = int((loads > t).sum())
        hs = network.states(x[t : t + STEPS, :on], fresh[t : t + STEPS, :on], h[:on])
        h = hs[-1]
        of_t = of[t : t + STEPS, :on].reshape(-1)
        real = of_t >= 0
        logs = network.logs(hs.reshape(-1, STATE)[real], y[t : t + STEPS, :on].reshape(-1)[real])
        total += np.bincount(of_t[real], weights=logs, minlength=len(documents))
    return total


def count_words(texts: DataFrame) -> DataFrame:
    """(``word``, ``ending``, ``c``) over all texts of a one-column frame; the word "" is
    the document's end. Tasks count portions first, then Spark adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in portions(batch.column(0)):
                words, counts = pc.value_counts(words_and_ends(some)[0]).flatten()
                yield pa.RecordBatch.from_arrays([words, spellings(words), counts], ["word", "ending", "c"])

    return texts.mapInArrow(run, "word binary, ending binary, c long").groupBy("word", "ending").agg(F.sum("c").alias("c"))


def head_least(counts: DataFrame) -> int:
    """The least count from which on at most HEAD words are in the head. Words are counted
    by their count, large counts in bins of less than 0.1 %, so what is gathered doesn't
    grow with the vocabulary; the tasks send no lists of words of their own."""
    c = F.col("c")
    bin_ = F.when(c < 2048, c).otherwise(2048 + F.floor(F.log2(c / 2048.0) * 1024).cast("long"))
    least, words = 1 << 62, 0
    for r in sorted(counts.groupBy(bin_.alias("bin")).agg(F.min("c").alias("least"), F.count("*").alias("n")).collect(), key=lambda r: -r.bin):
        words += r.n
        if words > HEAD:
            break
        least = r.least
    return least


def _averaged(texts: DataFrame, v, weights: dict[str, np.ndarray], turn: int) -> dict[str, np.ndarray]:
    """The average of the weights that the tasks reach from the same ones, by tokens."""
    sizes = _sizes(v.value)
    given = texts.sparkSession.sparkContext.broadcast(weights)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, reader, tokens = Network(v.value, dict(given.value)), Reader(v.value), 0
        for batch in batches:
            documents, held = [], 0
            for i, symbols in enumerate(reader.documents(batch.column(0))):
                documents.append(symbols)
                held += len(symbols)
                if held >= TOKENS or i == batch.num_rows - 1:
                    order = np.random.default_rng([turn, len(documents)]).permutation(len(documents))
                    tokens += train_on(network, [documents[k] for k in order])
                    documents, held = [], 0
        if tokens:
            flat = np.concatenate([network.w[k].reshape(-1) for k in sizes]).astype(np.float64) * tokens
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() % AVERAGES]), pa.array([tokens]), pa.array([flat.tobytes()], pa.binary())], ["part", "tokens", "sum"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total = 0, None
        for batch in batches:
            for n, flat in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tokens += n
                total = np.frombuffer(flat) + (0 if total is None else total)
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([tokens]), pa.array([total.tobytes()], pa.binary())], ["part", "tokens", "sum"])

    schema = "part long, tokens long, sum binary"
    rows = texts.mapInArrow(train, schema).repartition(AVERAGES, "part").mapInArrow(add, schema).collect()
    given.unpersist()
    if not rows:
        return weights
    flat = sum(np.frombuffer(r["sum"]) for r in sorted(rows, key=lambda r: (r.tokens, bytes(r["sum"])))) / sum(r.tokens for r in rows)
    out, at = {}, 0
    for k, shape in sizes.items():
        n = int(np.prod(shape))
        out[k] = flat[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return out


def score_documents(df: DataFrame, training: F.Column, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row for each row of ``df``: ``id``, ``held_out`` (not ``training``), ``n_tokens``,
    ``n_known``, ``train_tokens``, ``base_score`` and ``score``, the last two log10
    probabilities of the whole text by counts alone and by the model.

    Words are runs of bytes outside 0x20 and 0x09-0x0D, A-Z lowered, and one end. A null
    text is an empty one: its only token is the end. Rows that repeat an id are scored each
    by itself, and learned from each. Without training rows the base gives every token
    probability 1 and the model is an untrained one. A null id isn't trained on if
    ``training`` is then null. An empty table gives an empty result; other columns are left
    out.
    """
    spark = df.sparkSession
    kind = df.schema[id].dataType.simpleString()
    learn = F.coalesce(training, F.lit(False))
    rows = df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"), learn.alias("training"))
    counts = common.cut(count_words(rows.filter("training").select("text")))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    v = v if n else 0
    # Bounded by HEAD words, and by the 65536 pairs of bytes with and without marks.
    head = counts.filter((F.col("c") >= head_least(counts)) | (F.length("word") == 0)).select("word", "c").collect()
    head.sort(key=lambda r: (-r.c, bytes(r.word)))
    endings = counts.filter(F.length("word") > 0).groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    endings = sorted(((bytes(r.ending), r.c, r.v) for r in endings), key=lambda e: (-e[1], e[0]))
    known = vocabulary([(bytes(r.word), r.c) for r in head], endings, n, v)
    shared = spark.sparkContext.broadcast(known)

    part = F.pmod(F.xxhash64("id", "text"), F.lit(ROUNDS))
    weights = start_weights(known)
    for turn in range(ROUNDS):
        weights = _averaged(rows.filter(F.col("training") & (part == turn)).select("text"), shared, weights, turn)
    trained = spark.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        network, reader = Network(v, trained.value), Reader(v)
        uid = TaskContext.get().partitionId() << 40

        def part(batch: pa.RecordBatch, read: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> pa.RecordBatch:
            places, rare = np.concatenate([p for p, _, _ in read]), pa.concat_arrays([r for _, _, r in read])
            lengths = np.concatenate([np.diff(s) for _, s, _ in read])
            starts = np.cumsum(lengths) - lengths
            symbols = reader.symbols(places)
            logs = np.where(places >= 0, v.log_count[np.maximum(places, 0)], 0.0)
            # Words of a spelling class: log10 of (c + 0.5) / size; of rare ones, c comes later.
            fixed = np.where(symbols >= v.learned, logs - v.log_size[np.maximum(symbols - v.learned, 0)], 0.0)
            learned = score_all(network, np.split(symbols, starts[1:])) / np.log(10)
            of = np.searchsorted(starts, np.flatnonzero(places < 0), "right") - 1
            counted = pa.table([pa.array(of), rare], ["of", "word"]).group_by(["of", "word"], use_threads=False).aggregate([([], "count_all")])
            counted = counted.sort_by("of").combine_chunks()
            ends = np.searchsorted(counted["of"].to_numpy(), np.arange(len(lengths) + 1)).astype(np.int32)
            words = pa.StructArray.from_arrays([pa.concat_arrays(counted[c].chunks or [pa.array([], t)]) for c, t in (("word", pa.binary()), ("count_all", pa.int64()))], ["word", "n"])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(uid, uid + len(lengths)), pa.int64()), batch.column(0), batch.column(1), pa.array(lengths, pa.int64()),
                    pa.array(np.add.reduceat(logs, starts)), pa.array(learned + np.add.reduceat(fixed, starts)), pa.ListArray.from_arrays(pa.array(ends), words),
                ],
                ["uid", "id", "training", "tokens", "base", "score", "rare"],
            )

        for batch in batches:
            read, first, last, tokens = [], 0, 0, 0
            for some in portions(batch.column(2)):
                read.append(reader.read(some))
                last += len(some)
                tokens += len(read[-1][0])
                if tokens >= TOKENS or last == batch.num_rows:
                    yield part(batch.slice(first, last - first), read)
                    uid += last - first
                    read, first, tokens = [], last, 0

    scored = common.cut(
        rows.select("id", "training", "text").mapInArrow(
            score, f"uid long, id {kind}, training boolean, tokens long, base double, score double, rare array<struct<word: binary, n: long>>"
        )
    )
    rare = scored.select("uid", F.explode("rare").alias("r")).select("uid", "r.word", "r.n")
    rare = rare.join(counts.select("word", "c"), "word", "left").groupBy("uid").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_log"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum("n").alias("rare_n"),
    )
    zero = F.lit(0)
    extra = F.coalesce("rare_log", F.lit(0.0))
    return scored.drop("rare").join(rare, "uid", "left").select(
        F.col("id").alias(id),
        (~F.col("training")).alias("held_out"),
        F.col("tokens").alias("n_tokens"),
        (F.col("tokens") - F.coalesce("rare_n", zero) + F.coalesce("rare_known", zero) - (F.lit(0) if n else F.lit(1))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("tokens") * F.lit(float(np.log10(n + 0.5 * (v + 1))))).alias("base_score"),
        (F.col("score") + extra).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from those outside the held-out fifth."""
    return score_documents(common.documents(spark, sf_dir), common.crc32_of(F.col("doc_id")) % 5 != 1)
