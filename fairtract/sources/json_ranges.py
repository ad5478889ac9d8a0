"""Large JSON documents in byte ranges, whatever the document's size.

A classic export has one document per state, a single feature collection or a single object
keyed by id, which line-wise readers cannot split. Here a file is cut into ranges of bytes. A
byte alone does not tell whether it stands inside a string, so a first job reads every range
under both assumptions and notes quotes, depth and the last character; a running sum
over the ranges of a file, a few numbers each, then tells what each range begins with. In the
second job a range gives the records that *begin* in it, and reads past its end to finish the last one.

``array`` records are objects in an array at the second level (the features of a collection);
``entries`` are the members of the outermost object. Several documents in a file are fine.

A task reads a span of neighbouring ranges one after another and carries along what each begins with. So
a range bounds the memory of a task, while the number of tasks follows the cores and, beyond ``SPAN_BYTES`` each, the bytes.
Files are opened with pyarrow, so folders must be local, mounted, or of a store that it knows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 32 << 20
#: The most bytes of a span, unless a single range has more, and the spans of a core while they are less.
SPAN_BYTES = 32 << 20
SPANS_PER_CORE = 4
#: Bytes that are read first to finish a record beyond its range.
_TAIL = 1 << 12
_BATCH = 1_000

_LEVEL = np.zeros(256, np.int8)
_LEVEL[[ord("{"), ord("[")]] = 1
_LEVEL[[ord("}"), ord("]")]] = -1
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\r\n")] = True


@dataclass
class Range(InputPartition):
    """Bytes of a file, ``step`` at a time (0: at once), and what stands before them: whether a string is open, the depth, the last character."""

    file: str
    start: int
    stop: int
    in_string: bool = False
    depth: int = 0
    last: int = 0
    step: int = 0

    def windows(self) -> Iterator[tuple[int, int]]:
        step = self.step or max(self.stop - self.start, 1)
        for a in range(self.start, self.stop, step):
            yield a, min(a + step, self.stop)


def _open(file: str):
    if file.startswith("file:"):
        return open("/" + file[5:].lstrip("/"), "rb")
    if file.startswith("/"):
        return open(file, "rb")
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", file))
    return system.open_input_file(path)


def _read(source, start: int, stop: int) -> bytes:
    source.seek(start)
    return source.read(stop - start)


def _escaped(source, start: int) -> bool:
    """Whether the byte at ``start`` follows an odd number of backslashes."""
    n, size = 0, 64
    while start:
        before = _read(source, max(start - size, 0), start)
        n = len(before) - len(before.rstrip(b"\\"))
        if n < len(before) or size >= start:
            break
        size *= 64
    return n % 2 == 1


def _text(source, start: int, stop: int) -> tuple[bytes, np.ndarray]:
    """Bytes of a range, and the same as numbers with escaped characters masked."""
    data = _read(source, start, stop)
    plain = data
    if _escaped(source, start):
        plain = b"x" + plain[1:]
    if b"\\" in plain:
        plain = re.sub(rb"\\.", b"xx", plain, flags=re.DOTALL)
    return data, np.frombuffer(plain, np.uint8)


def _inside(text: np.ndarray, in_string: bool) -> np.ndarray:
    """Whether each byte belongs to a string, its opening quote included, its closing quote not."""
    return ((np.cumsum(text == ord('"'), dtype=np.uint8) & 1) == 1) ^ in_string


def _summary(text: np.ndarray, in_string: bool) -> tuple[int, int]:
    """Change of depth and last character outside of strings; quotes are outside."""
    outside = ~_inside(text, in_string) | (text == ord('"'))
    seen = np.flatnonzero(outside & ~_BLANK[text])
    return int(_LEVEL[text[outside]].sum(dtype=np.int64)), int(text[seen[-1]]) if len(seen) else 0


class _Structure:
    """Structural places of a text: ``at`` with depths ``before`` and ``after``, quotes, and the characters that precede."""

    def __init__(self, text: np.ndarray, in_string: bool, depth: int, last: int):
        self.text, self.start_depth, self.last = text, depth, last
        inside = _inside(text, in_string)
        quote = text == ord('"')
        level = np.where(inside, 0, _LEVEL[text])
        self.at = np.flatnonzero(level)
        self.after = depth + np.cumsum(level[self.at], dtype=np.int64)
        self.before = self.after - level[self.at]
        self.opening, self.closing = np.flatnonzero(quote & inside), np.flatnonzero(quote & ~inside)
        self.commas = np.flatnonzero((text == ord(",")) & ~inside)
        self.seen = np.flatnonzero((~inside | quote) & ~_BLANK[text])

    def depth_at(self, places: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.at, places) - 1
        return np.where(i >= 0, self.after[np.maximum(i, 0)] if len(self.at) else self.start_depth, self.start_depth)

    def follows(self, places: np.ndarray, characters: bytes) -> np.ndarray:
        i = np.searchsorted(self.seen, places) - 1
        before = np.where(i >= 0, self.text[self.seen[np.maximum(i, 0)]] if len(self.seen) else 0, self.last)
        return np.isin(before, list(characters))

    def records(self, kind: str) -> tuple[np.ndarray, np.ndarray]:
        """Where records begin, and where a record may end (the end of one is the first after its begin)."""
        if kind == "array":
            opens = self.at[(self.text[self.at] == ord("{")) & (self.before == 2)]
            return opens[self.follows(opens, b"[,")], self.at[(self.text[self.at] == ord("}")) & (self.after == 2)] + 1
        keys = self.opening[self.depth_at(self.opening) == 1]
        ends = np.concatenate([self.commas[self.depth_at(self.commas) == 1], self.at[self.after == 0]])
        return keys[self.follows(keys, b"{,")], np.sort(ends)


def _finish(source, start: int, kind: str) -> bytes:
    """The record that begins at ``start``, read until it ends."""
    size = _TAIL
    while True:
        data, text = _text(source, start, start + size)
        depth, last = (2, ord(",")) if kind == "array" else (1, ord(","))
        _, ends = _Structure(text, False, depth, last).records(kind)
        if len(ends):
            return data[: ends[0]]
        if len(data) < size:
            return data
        size *= 4


def _split_entry(entry: bytes) -> tuple[str, str]:
    end = re.match(rb'"(?:[^"\\]|\\.)*"', entry, re.DOTALL).end()
    return json.loads(entry[:end]), entry[end:].lstrip()[1:].strip().decode()


class _Scan(DataSourceReader):
    def __init__(self, ranges: list[Range]):
        self.ranges = ranges

    def partitions(self) -> list[Range]:
        return self.ranges

    def __getstate__(self) -> dict:
        # Tasks get their own range only.
        return {**self.__dict__, "ranges": []}

    def read(self, part: Range) -> Iterator[tuple]:
        """Under both assumptions on its begin: change of depth and last character; and whether the quotes are odd."""
        odd, down, last = 0, [0, 0], [0, 0]
        with _open(part.file) as source:
            for a, b in part.windows():
                _, text = _text(source, a, b)
                for begin in (0, 1):
                    more, seen = _summary(text, bool(begin ^ odd))
                    down[begin], last[begin] = down[begin] + more, seen or last[begin]
                odd ^= int(np.count_nonzero(text == ord('"'))) % 2
        yield (part.file, part.start, odd, down[0], last[0], down[1], last[1])


class _Records(_Scan):
    def __init__(self, ranges: list[Range], kind: str):
        super().__init__(ranges)
        self.kind = kind

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        in_string, depth, last = part.in_string, part.depth, part.last
        rows = []
        with _open(part.file) as source:
            for a, b in part.windows():
                data, text = _text(source, a, b)
                begins, ends = _Structure(text, in_string, depth, last).records(self.kind)
                place = np.searchsorted(ends, begins, "right")
                for begin, i in zip(begins.tolist(), place.tolist()):
                    record = data[begin : ends[i]] if i < len(ends) else _finish(source, a + begin, self.kind)
                    key, value = _split_entry(record) if self.kind == "entries" else (None, record.decode())
                    rows.append((part.file, a + begin, key, value))
                    if len(rows) == _BATCH:
                        yield _batch(rows)
                        rows = []
                if b < part.stop:
                    down, seen = _summary(text, in_string)
                    in_string ^= bool(np.count_nonzero(text == ord('"')) % 2)
                    depth, last = depth + down, seen or last
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["file", "start", "key", "value"])


class JsonRanges(DataSource):
    """``json_ranges``: option ``ranges`` lists them as JSON; without ``records`` they are only scanned."""

    @classmethod
    def name(cls) -> str:
        return "json_ranges"

    def schema(self) -> str:
        if "records" in self.options:
            return "file string, start long, key string, value string"
        return "file string, start long, quotes int, down0 long, last0 int, down1 long, last1 int"

    def reader(self, schema) -> DataSourceReader:
        ranges = [Range(*r) for r in json.loads(self.options["ranges"])]
        return _Records(ranges, self.options["records"]) if "records" in self.options else _Scan(ranges)


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Data files below a path and their sizes."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    prefix = system.makeQualified(root).toString()
    found, listing = [], system.listFiles(root, True)
    while listing.hasNext():
        status = listing.next()
        name = status.getPath().toString()
        hidden = any(part.startswith(("_", ".")) for part in name[len(prefix) :].split("/") if part)
        if not hidden and status.getLen():
            found.append((name, status.getLen()))
    return sorted(found)


def _dump(ranges: list[Range]) -> str:
    return json.dumps([(r.file, r.start, r.stop, r.in_string, r.depth, r.last, r.step) for r in ranges])


def _span(total: int, range_bytes: int, cores: int) -> int:
    """Bytes of a task: whole ranges, at least one."""
    share = min(SPAN_BYTES, total // (SPANS_PER_CORE * cores))
    return max(share // range_bytes, 1) * range_bytes


def read_records(spark: SparkSession, path: str, records: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``file, start, key, value`` of each record: its place, its key (entries only) and its JSON text."""
    spark.dataSource.register(JsonRanges)
    files = files_of(spark, path)
    span = _span(sum(size for _, size in files), range_bytes, spark.sparkContext.defaultParallelism)
    ranges = [Range(file, a, min(a + span, size), step=range_bytes) for file, size in files for a in range(0, size, span)]
    several = [r for i, r in enumerate(ranges) if r.start or (i + 1 < len(ranges) and ranges[i + 1].start)]
    if several:
        rows = spark.read.format("json_ranges").option("ranges", _dump(several)).load().collect()
        scanned = {(row.file, row.start): row for row in rows}
        state = (False, 0, 0)
        for r in ranges:
            if not r.start:
                state = (False, 0, 0)
            r.in_string, r.depth, r.last = state
            row = scanned.get((r.file, r.start))
            if row is not None:
                down, last = (row.down1, row.last1) if r.in_string else (row.down0, row.last0)
                state = (r.in_string ^ bool(row.quotes), r.depth + down, last or r.last)
    return spark.read.format("json_ranges").option("ranges", _dump(ranges)).option("records", records).load()
