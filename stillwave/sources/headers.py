"""A data source of miniSEED headers, which reads no samples.

Files are split into ranges of bytes, and small ones put together; a task goes from header to
header and reads 64 bytes of each record. Files must lie in folders that executors can open; those in other
stores are read by :func:`stillwave.sources.miniseed.read_miniseed`.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from stillwave.sources import miniseed

SCHEMA = "path string, offset long, length int, network string, station string, location string, channel string, starttime timestamp_ntz, npts long, rate double, encoding int"
_KINDS = [pa.string(), pa.int64(), pa.int32(), *[pa.string()] * 4, pa.timestamp("us"), pa.int64(), pa.float64(), pa.int32()]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Bytes that are read of a record, if its blockettes lie within them.
HEAD = 64
#: Bytes of files that are one partition, of which a task reads about a sixtieth, and how many
#: files it may have.
RANGE, FILES = 1 << 30, 64
#: Headers in a batch.
ROWS = 8192


def walk(file: BinaryIO, first: int, end: int) -> Iterator[tuple[int, miniseed.Header]]:
    """(offset, header) of the records that begin in [first, end) of a file, all of which are as
    long as its first one; one that isn't is an error, as it can't be known where others begin."""

    def at(offset: int) -> miniseed.Header | None:
        file.seek(offset)
        head = file.read(HEAD)

        def read(a: int, b: int) -> bytes:
            if b <= HEAD:
                return head[a:b]
            file.seek(offset + a)
            return file.read(b - a)

        return miniseed.header(read)

    start = at(0)
    length = start.length if start else 1
    offset = -(-first // length) * length
    while offset < end and (found := start if offset == 0 else at(offset)):
        if found.length != length:
            raise ValueError(f"a record of {found.length} bytes at {offset} among those of {length}")
        yield offset, found
        offset += length


@dataclass
class Ranges(InputPartition):
    """(path, start, end) of what one task reads."""

    pieces: list[tuple[str, int, int]]


#: How a filter that is pushed down tests a header's value.
_TESTS = {
    EqualTo: lambda v, w: v == w, In: lambda v, w: v in w, GreaterThan: lambda v, w: v > w, GreaterThanOrEqual: lambda v, w: v >= w,
    LessThan: lambda v, w: v < w, LessThanOrEqual: lambda v, w: v <= w,
}


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"].removeprefix("file://").removeprefix("file:")
        if "://" in self.folder:
            raise ValueError(f"{self.folder} is in a store that only Spark reads; use read_miniseed")
        self.pattern, self.range = options.get("pattern", "*"), int(options.get("range", RANGE))
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        """Takes comparisons of codes and start times; Spark keeps the rest."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in _TESTS and name in ("network", "station", "location", "channel", "starttime"):
                self.tests.append((name, type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Ranges]:
        out: list[Ranges] = []
        room = 0
        files = [self.folder] if os.path.isfile(self.folder) else (os.path.join(d, f) for d, _, names in os.walk(self.folder) for f in names)
        for path in sorted(files):
            if fnmatch.fnmatch(os.path.basename(path), self.pattern):
                size = os.path.getsize(path)
                for start in range(0, size, self.range):
                    end = min(size, start + self.range)
                    if not out or end - start > room or len(out[-1].pieces) >= FILES:
                        out.append(Ranges([]))
                        room = self.range
                    out[-1].pieces.append((path, start, end))
                    room -= end - start
        return out

    def passes(self, header: miniseed.Header) -> bool:
        for name, kind, value in self.tests:
            held = getattr(header, name)
            if isinstance(held, dt.datetime) and isinstance(value, dt.datetime) and value.tzinfo:
                value = value.astimezone(dt.UTC).replace(tzinfo=None)
            if not _TESTS[kind](held, value):
                return False
        return True

    def read(self, partition: Ranges | None) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        as_batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS)], _NAMES)
        for path, start, end in partition.pieces if partition else []:  # None: no file at all
            with open(path, "rb", buffering=0) as file:
                try:
                    for offset, h in walk(file, start, end):
                        if self.passes(h):
                            rows.append((path, offset, h.length, *h[:8]))
                        if len(rows) >= ROWS:
                            yield as_batch()
                            rows.clear()
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e
        if rows:
            yield as_batch()


class HeaderSource(DataSource):
    """``spark.read.format("miniseed_headers").load(folder)``, with ``pattern`` of names and ``range``."""

    @classmethod
    def name(cls) -> str:
        return "miniseed_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options)


def read_headers(spark: SparkSession, path: str, pattern: str = "*", bytes_in_range: int = RANGE) -> DataFrame:
    """The headers of the files below ``path`` whose names match, one row each. Filters on codes and
    start times are tested where headers are read; for that the session's switch of filters
    for Python sources is turned on. A file of records of unequal length is an error."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HeaderSource)
    return spark.read.format("miniseed_headers").option("pattern", pattern).option("range", bytes_in_range).load(path)
