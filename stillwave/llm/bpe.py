"""BPE encoding and decoding with content-defined chunk reuse, and a byte-level encoder.

Whole texts are cut where a rolling hash of the last bytes has its low bits clear, so that
passages that documents share fall into equal chunks wherever they stand. A chunk is encoded
once and kept; what stands between a chunk's first and its last white space can't depend on
its neighbours. The joins are then repaired: the rest of one chunk and the beginning of the
next are put together and encoded again, and the piece grows over whole chunks until it
reaches white space on both sides, where the two encodings agree exactly.

The kept chunks and words belong to a worker process and are bounded; a worker that is lost
or full only encodes again. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from stillwave.llm import common

#: Most words and most bytes of chunks that a worker keeps.
WORDS_KEPT = 600_000
CHUNK_BYTES_KEPT = 48 << 20
#: A cut falls after one byte in so many, on average.
CHUNK_BYTES = 512
#: Longer words and chunks are encoded but not kept.
LONGEST_KEPT = 1 << 14

_GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


def cuts(data: bytes, average: int = CHUNK_BYTES) -> list[int]:
    """Ends of the content-defined chunks, the text's own end included.

    The gear hash of a place is the sum of a random number for each of the last 32 bytes,
    shifted by its distance; doubling builds it for all places in five steps.
    """
    if not data:
        return []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    span = 1
    while span < 32:
        h[span:] += h[:-span].copy() << np.uint32(span) if len(h) > span else 0
        span *= 2
    bits = max(1, average.bit_length() - 1)
    found = (np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1).tolist()
    if not found or found[-1] != len(data):
        found.append(len(data))
    return found


class WordEncoder(dict):
    """Word to (ids as decimal text, tokens as text, count); both texts end in a space.

    Words of printable ASCII and Latin-1 letters are lowered and cut into the pieces that
    the vocabulary's own pattern finds, which are kept too: a word with a capital or a
    comma costs no call then. All other words, and those with special strings, go to the
    library whole.
    """

    PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
    #: Fixed value: the pattern of the vocabulary, for those letters.
    PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

    def __init__(self, path: str):
        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.plain = "[\\p{L}]+|[\\p{N}]|" in self.library.to_str().replace("\\\\", "\\")
        self.special = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.texts = [(f"{i} ".encode(), f"{self.library.id_to_token(i)} ".encode()) for i in range(self.library.get_vocab_size())]
        self.pieces: dict[str, tuple[bytes, bytes, int]] = {}
        self.model = self.library.model
        sign = {b: s for s, b in _byte_of_sign().items()}
        self.signs = {c: "".join(sign[b] for b in chr(c).encode()) for c in range(128, 256)}

    def _library(self, text: str) -> tuple[bytes, bytes, int]:
        return self._texts(self.library.encode(text, add_special_tokens=False).ids)

    def _texts(self, ids: list[int]) -> tuple[bytes, bytes, int]:
        found = [self.texts[i] for i in ids]
        return b"".join([a for a, _ in found]), b"".join([b for _, b in found]), len(ids)

    def _piece(self, piece: str) -> tuple[bytes, bytes, int]:
        found = self.pieces.get(piece)
        if found is None:
            found = self._texts([t.id for t in self.model.tokenize(piece.translate(self.signs))])
            if len(self.pieces) >= WORDS_KEPT // 2:
                self.pieces.clear()
            self.pieces[piece] = found
        return found

    def __missing__(self, word: bytes) -> tuple[bytes, bytes, int]:
        text = word.decode("utf-8", "surrogatepass")
        if len(word) > LONGEST_KEPT:
            return self._library(text)
        if self.plain and self.PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            parts = [self._piece(p) for p in self.PIECE.findall(text.lower())]
            value = parts[0] if len(parts) == 1 else (b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts]), sum(p[2] for p in parts))
        else:
            value = self._library(text)
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = value
        return value


class ChunkEncoder:
    """Encodes whole texts for a vocabulary whose words end at white space."""

    def __init__(self, path: str):
        self.words = WordEncoder(path)
        decoder = json.loads(self.words.library.to_str())["decoder"]
        if decoder is not None:
            raise ValueError("only vocabularies without a decoder, whose tokens are joined by spaces")
        self.chunks: dict[bytes, tuple] = {}
        self.kept = 0
        self.reused = self.encoded = 0

    def _encode_chunk(self, chunk: bytes) -> tuple:
        """(rest before the first white space, ids, tokens, count, rest after the last), or
        an empty tuple for a chunk without white space."""
        words = chunk.split()
        first, last = chunk[:1].isspace(), chunk[-1:].isspace()
        if len(words) < 2 and not (first or last):
            return ()
        head = b"" if first or not words else words.pop(0)
        tail = b"" if last or not words else words.pop()
        values = list(map(self.words.__getitem__, words))
        return head, b"".join(v[0] for v in values), b"".join(v[1] for v in values), sum(v[2] for v in values), tail

    def chunk(self, chunk: bytes) -> tuple:
        found = self.chunks.get(chunk)
        if found is None:
            self.encoded += 1
            found = self._encode_chunk(chunk)
            if len(chunk) <= LONGEST_KEPT:
                if self.kept > CHUNK_BYTES_KEPT:
                    self.chunks.clear()
                    self.kept = 0
                self.chunks[chunk] = found
                self.kept += 300 + len(chunk) + sum(map(len, (found[1], found[2]))) if found else 100 + len(chunk)
        else:
            self.reused += 1
        return found

    def encode(self, text: str) -> tuple[int, bytes, bytes]:
        """Number of ids, ids as decimal text, tokens as text; parts joined by one space."""
        data = text.encode("utf-8", "surrogatepass")
        ids, tokens, n, start = [], [], 0, 0
        join: list[bytes] = []
        for end in cuts(data):
            found = self.chunk(data[start:end])
            if not found:
                join.append(data[start:end])
            else:
                if piece := b"".join([*join, found[0]]):
                    a, b, k = self.words[piece]
                    ids.append(a)
                    tokens.append(b)
                    n += k
                ids.append(found[1])
                tokens.append(found[2])
                n += found[3]
                join = [found[4]]
            start = end
        if piece := b"".join(join):
            a, b, k = self.words[piece]
            ids.append(a)
            tokens.append(b)
            n += k
        return n, b"".join(ids)[:-1], b"".join(tokens)[:-1]


@cache
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def encode_documents(df: DataFrame, vocabulary: str, text: str = "text", id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row for each row of ``df``: ``id``, ``n_tokens``, ``ids_sha256`` and
    ``decoded_sha256``, and with ``with_ids`` also ``ids`` (array of int) and ``decoded``.

    ``vocabulary`` names a file of public_tokenizers, which every worker finds by itself.
    A null text is as an empty one: no ids, the digests of empty texts. Repeated rows are
    encoded each by itself. A null id stays null, and an empty table gives an empty result.
    Other columns are left out. Texts of any length are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(public_tokenizers.path(vocabulary))
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for value in batch.column(1):
                n, ids, tokens = encoder.encode(value.as_py() or "")
                out[0].append(n)
                out[1].append(hashlib.sha256(ids).hexdigest())
                out[2].append(hashlib.sha256(tokens).hexdigest())
                if with_ids:
                    out[3].append(np.array(ids.split(), np.int32))
                    out[4].append(tokens.decode("utf-8", "surrogatepass"))
            columns = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = df.schema[id].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return df.select(df[id], df[text].cast("string")).mapInArrow(run, schema).withColumnRenamed("id", id)


class ByteEncoder(dict):
    """Byte-level BPE: a piece that follows a space to its ids, as little-endian 32 bits.

    A space between two other signs than white space always begins a new piece of the
    pattern, so the pieces between such spaces can be encoded one by one and kept. The same
    holds for a single line break. They go to tiktoken with the vocabulary's ranks. A special
    string ends what stands before it as the text's end does, so texts that hold one go to
    the tokenizers library whole.
    """

    #: White space other than spaces and line breaks.
    RARE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
    BREAK = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str):
        import tiktoken

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        shape = json.loads(self.library.to_str())
        special = {t["content"] for t in shape["added_tokens"]}
        self.special = tuple(special)
        as_byte = _byte_of_sign()
        ranks = {bytes(as_byte[c] for c in token): i for token, i in shape["model"]["vocab"].items() if token not in special}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first: dict[str, bytes] = {}
        self.newline = self._ids("\n")

    def _ids(self, piece: str) -> bytes:
        return array("I", self.ranks.encode_ordinary(piece)).tobytes()

    def start(self, piece: str) -> bytes:
        """Ids of a piece that follows no space."""
        found = self.first.get(piece)
        if found is None:
            found = self._ids(piece)
            if len(piece) <= LONGEST_KEPT:
                if len(self.first) >= WORDS_KEPT // 4:
                    self.first.clear()
                self.first[piece] = found
        return found

    def __missing__(self, piece: str) -> bytes:
        found = self._ids(f" {piece}")
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        if (
            "  " in text or " \n" in text or "\n " in text or "\n\n\n" in text
            or text.endswith("\n\n") or self.RARE.search(text)
        ):
            first, *rest = self.BREAK.split(text)
            return b"".join([self._ids(first), *map(self._ids, map(" {}".format, rest))])
        out = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(self.start(first))
            out.extend(map(self.__getitem__, rest))
            out.append(self.newline)
        out.pop()
        return b"".join(out)


def _byte_of_sign() -> dict[str, int]:
    """The byte for each printable sign of byte-level vocabularies: printable bytes stand
    for themselves, the others follow from 256 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@cache
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded with the word-end vocabulary."""
    return encode_documents(common.documents(spark, sf_dir), "word_bpe_49k.json")
