"""Records of miniSEED 2 files, read through Spark's binary files from any store.

Written from the public SEED manual: the fixed header of 48 bytes, blockette 1000, samples of
16 and 32 bit integers and 32 and 64 bit floats, and the compressions Steim 1 and 2.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import os
import struct
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_PLAIN = {1: "i2", 3: "i4", 4: "f4", 5: "f8"}
_EPOCH = dt.datetime(1970, 1, 1)
#: Steim 2: by frame code and the word's top two bits, how many differences of how many bits.
_STEIM2 = {(1, None): (4, 8), (2, 1): (1, 30), (2, 2): (2, 15), (2, 3): (3, 10), (3, 0): (5, 6), (3, 1): (6, 5), (3, 2): (7, 4)}
SCHEMA = "path string, network string, station string, location string, channel string, starttime timestamp_ntz, npts long, rate double, encoding int, samples array<double>, problem string"


def _steim(data: bytes, order: str, count: int, two: bool) -> np.ndarray:
    """Samples from frames of 64 bytes; the last one is checked against the header's. All words
    of one kind are unpacked together, and the differences sorted by their place."""
    words = np.frombuffer(data[: len(data) // 64 * 64], f"{order}u4").astype(np.int64).reshape(-1, 16)
    code = words[:, :1] >> (30 - 2 * np.arange(16)) & 3
    code[:, 0] = 0
    signed = lambda v, bits: v - (v >> (bits - 1) << bits)
    first, last = (int(signed(words[0, k], 32)) for k in (1, 2)) if len(words) else (0, 0)
    code[:1, 1:3] = 0
    words, code = words.reshape(-1), code.reshape(-1)
    shapes = _STEIM2 if two else {(1, None): (4, 8), (2, None): (2, 16), (3, None): (1, 32)}
    top = words >> 30
    places, values, known = [], [], code == 0
    for (kind, sub), (n, bits) in shapes.items():
        at = np.flatnonzero((code == kind) & (True if sub is None else top == sub))
        known[at] = True
        shift = bits * np.arange(n - 1, -1, -1)
        values.append(signed(words[at, None] >> shift & (1 << bits) - 1, bits).reshape(-1))
        places.append((at[:, None] * 8 + np.arange(n)).reshape(-1))
    if not known.all():
        raise ValueError("unknown Steim 2 code")
    places, values = np.concatenate(places), np.concatenate(values)
    if len(values) < count:
        raise ValueError(f"{len(values)} differences for {count} samples")
    differences = values[np.argsort(places, kind="stable")][1:count]
    out = first + np.concatenate([[0], np.cumsum(differences)])
    if count and out[-1] != last:
        raise ValueError("the last sample differs from the header's")
    return out.astype(float)


def _rate(factor: int, multiplier: int) -> float:
    base = float(factor) if factor > 0 else -1.0 / factor if factor else 0.0
    return base * multiplier if multiplier > 0 else base / -multiplier if multiplier else base


class Header(NamedTuple):
    """What a record's first bytes tell of it; ``begin`` and ``length`` are in bytes."""

    network: str
    station: str
    location: str
    channel: str
    starttime: dt.datetime
    npts: int
    rate: float
    encoding: int | None
    byte_order: str
    begin: int
    length: int


def header(read: Callable[[int, int], bytes]) -> Header | None:
    """The header of the record of which ``read(a, b)`` gives bytes a to b; None at the end."""
    head = read(0, 48)
    if len(head) < 48:
        return None
    order = ">" if 1900 <= struct.unpack(">H", head[20:22])[0] <= 2200 else "<"
    year, doy, hour, minute, second, _, fraction = struct.unpack(f"{order}HHBBBBH", head[20:30])
    npts, factor, multiplier = struct.unpack(f"{order}Hhh", head[30:36])
    activity, correction = head[36], struct.unpack(f"{order}i", head[40:44])[0]
    begin, blockette = struct.unpack(f"{order}HH", head[44:48])
    encoding, length, byte_order = None, 4096, order
    while blockette and len(found := read(blockette, blockette + 8)) == 8:
        kind, following = struct.unpack(f"{order}HH", found[:4])
        if kind == 1000:
            encoding, length, byte_order = found[4], 1 << found[6], ">" if found[5] else "<"
        if following <= blockette:
            break
        blockette = following
    start = _EPOCH.replace(year=year) + dt.timedelta(days=doy - 1, hours=hour, minutes=minute, seconds=second, microseconds=100 * fraction)
    if not activity & 2:  # the correction isn't in the time yet
        start += dt.timedelta(microseconds=100 * correction)
    text = lambda a, b: head[a:b].decode("ascii", "replace").strip()
    return Header(text(18, 20), text(8, 13), text(13, 15), text(15, 18), start, npts, _rate(factor, multiplier), encoding, byte_order, begin, length)


def records(data: bytes) -> Iterator[tuple]:
    """Each record's header and samples, and what was wrong with it, if anything."""
    at = 0
    while h := header(lambda a, b, at=at: data[at + a : at + b]):
        samples, problem = None, None
        body = data[at + h.begin : at + h.length]
        try:
            if h.encoding in _PLAIN:
                samples = np.frombuffer(body, h.byte_order + _PLAIN[h.encoding], h.npts).astype(float)
            elif h.encoding in (10, 11):
                samples = _steim(body, h.byte_order, h.npts, h.encoding == 11)
            else:
                problem = f"encoding {h.encoding} isn't read"
        except (ValueError, KeyError, struct.error) as e:
            problem = str(e)
        yield *h[:8], samples, problem
        at += h.length


def encode(network: str, station: str, location: str, channel: str, start: dt.datetime, rate: float, samples: np.ndarray, length: int = 4096) -> bytes:
    """Records of 64-bit floats that hold a trace; whole rates, or whole periods below one."""
    out, room = [], (length - 64) // 8
    factor = int(round(rate)) if rate >= 1 else -int(round(1 / rate))
    for k in range(0, len(samples), room):
        part = np.asarray(samples[k : k + room], ">f8")
        t = start + dt.timedelta(microseconds=round(k / rate * 1e6))
        names = f"{station[:5]:<5}{location[:2]:<2}{channel[:3]:<3}{network[:2]:<2}".encode()
        head = f"{k // room % 1_000_000:06d}D ".encode() + names
        head += struct.pack(">HHBBBBH", t.year, t.timetuple().tm_yday, t.hour, t.minute, t.second, 0, t.microsecond // 100)
        head += struct.pack(">Hhh", len(part), factor, 1) + bytes([0, 0, 0, 1]) + struct.pack(">iHH", 0, 64, 48)
        head += struct.pack(">HHBBBB", 1000, 0, 5, 1, length.bit_length() - 1, 0)
        out.append((head.ljust(64, b"\0") + part.tobytes()).ljust(length, b"\0"))
    return b"".join(out)


def encoded(traces: DataFrame) -> DataFrame:
    """(``path``, ``content``) of traces ``network``, ``station``, ``location``, ``channel``,
    ``starttime``, ``rate``, ``samples``: one file's bytes for each row, named by code and time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns[:6]), batch.column(6), strict=True))
            paths = [f"{r[0]}/{r[1]}/{r[3]}/{'.'.join(map(str, r[:4]))}.{r[4]:%Y.%j.%H%M%S%f}" for r in rows]
            content = [encode(*r[:6], r[6].values.to_numpy(zero_copy_only=False)) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(content, pa.binary())], ["path", "content"])

    columns = ["network", "station", "location", "channel", "starttime", "rate", "samples"]
    return traces.select(*columns).mapInArrow(run, "path string, content binary")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """(``path``, ``bytes``, ``sha256``) of files (``path``, ``content``) once they are written below
    a folder that all executors share. Each is written beside its place and then moved there,
    so a task that runs again leaves it whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = [], []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                path = os.path.join(folder, name)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                part = f"{path}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as file:
                    sizes.append(file.write(content.as_buffer()))
                digests.append(hashlib.sha256(content.as_buffer()).hexdigest())
                os.replace(part, path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], ["path", "bytes", "sha256"])

    return files.select("path", "content").mapInArrow(run, "path string, bytes long, sha256 string")


class BadFile(RuntimeError):
    """A file that is missing, or isn't what was written."""


def checked(wanted: DataFrame, folder: str, strict: bool = True) -> DataFrame:
    """The rows of ``wanted`` (``path``, ``bytes``, ``sha256`` as :func:`write_files` gave them, and
    any other columns) with ``content`` and ``problem``. No other file is opened.

    A null path, a file that isn't there, and one whose length or digest differs have a null
    content and a problem that says so; with ``strict`` the first one is an error that names it.
    The length is compared before anything is read. Columns called ``content`` or ``problem``
    are replaced.
    """
    columns = [c for c in wanted.columns if c not in ("content", "problem")]
    places = [columns.index(c) for c in ("path", "bytes", "sha256")]

    def load(name: str | None, size: int | None, digest: str | None) -> bytes:
        if name is None:
            raise BadFile("no file")
        path = os.path.join(folder, name)
        try:
            found = os.path.getsize(path)
            if found != size:
                raise BadFile(f"{name}: {found} bytes instead of {size}")
            with open(path, "rb") as file:
                data = file.read()
        except FileNotFoundError as e:
            raise BadFile(f"{name}: missing") from e
        if hashlib.sha256(data).hexdigest() != digest:
            raise BadFile(f"{name}: the content's digest isn't {digest}")
        return data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(zip(*(batch.column(k).to_pylist() for k in places), strict=True)):
                content = problem = None
                try:
                    content = load(*row)
                except BadFile as e:
                    if strict:
                        raise
                    problem = str(e)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([content], pa.binary()), pa.array([problem], pa.string())], [*batch.schema.names, "content", "problem"])

    kinds = ", ".join(f"`{c}` {wanted.schema[c].dataType.simpleString()}" for c in columns)
    return wanted.select(*columns).mapInArrow(run, f"{kinds}, content binary, problem string")


def decoded(files: DataFrame, strict: bool = False) -> DataFrame:
    """One row for each record of files (``path``, ``content``). A record that can't be decoded
    has null samples and its ``problem``; with ``strict`` it is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.timestamp("us"), pa.int64(), pa.float64(), pa.int32(), pa.list_(pa.float64()), pa.string()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(name, *r) for r in records(content.as_buffer().to_pybytes())]
                if strict and (bad := next((r[-1] for r in rows if r[-1]), None)):
                    raise ValueError(f"{name}: {bad}")
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_miniseed(spark: SparkSession, path: str | list[str], pattern: str = "*", strict: bool = False) -> DataFrame:
    """The records of the files below ``path`` whose names match, as :func:`decoded` gives them."""
    return decoded(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path), strict)


def time_series_index(records: DataFrame) -> DataFrame:
    """One row for each file and channel: first and last time, records, samples and rates."""
    from pyspark.sql import functions as F

    span = F.expr("make_dt_interval(0, 0, 0, CAST((npts - 1) / rate AS DECIMAL(18, 6)))")
    return records.filter("rate > 0").groupBy("path", "network", "station", "location", "channel").agg(
        F.min("starttime").alias("starttime"), F.max(F.col("starttime") + span).alias("endtime"), F.count("*").alias("records"),
        F.sum("npts").alias("npts"), F.array_sort(F.collect_set("rate")).alias("rates"),
    )
