"""A Python data source that streams objects: byte ranges, decompressed lines, archive members, JSON values, a UTF-8 check.

No object is held whole: a range is read by seeking, the others as streams of pieces. The planner lists the files; an object is one task's
work, but for ranges, which are cut into pieces of ``piece`` bytes at line breaks.
"""

from __future__ import annotations

import bz2
import gzip
import io
import json
import re
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMAS = {
    "range": "path string, line string",
    "lines": "path string, line string, error string",
    "members": "path string, member string, size long, content binary",
    "list": "path string, member string, size long",
    "values": "path string, value string",
    "check": "path string, valid boolean",
}
#: Bytes that are read at a time.
CHUNK = 1 << 20
SPACE = re.compile(r"\s*")


def store_of(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


class Piece(InputPartition):
    """Bytes ``start`` to ``end`` (exclusive) of an object, in a range that goes to ``until``."""

    def __init__(self, path: str, start: int = 0, end: int = 0, until: int = 0, first: bool = True):
        super().__init__(0)
        self.path, self.start, self.end, self.until, self.first = path, start, end, until, first


def opened(raw: io.BufferedIOBase) -> io.BufferedIOBase:
    """A stream of the plain bytes, by what the object begins with."""
    head = raw.peek(4)[:4] if hasattr(raw, "peek") else b""
    if head[:2] == b"\x1f\x8b":
        return gzip.open(raw)
    if head[:3] == b"BZh":
        return bz2.open(raw)
    if head == b"\x28\xb5\x2f\xfd":
        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True))
    if head == b"\x04\x22\x4d\x18":
        return pa.CompressedInputStream(pa.PythonFile(raw, "r"), "lz4")
    return raw


def plain_lines(stream: io.BufferedIOBase) -> Iterator[tuple[str | None, str | None]]:
    """The lines of a stream; a damaged one ends with the error."""
    rest = b""
    try:
        while piece := stream.read(CHUNK):
            *whole, rest = (rest + piece).split(b"\n")
            yield from ((w.decode("utf-8", "replace"), None) for w in whole)
        if rest:
            yield rest.decode("utf-8", "replace"), None
    except (OSError, EOFError, zlib.error, zstandard.ZstdError, pa.ArrowInvalid) as e:
        yield None, "truncated" if isinstance(e, EOFError) else "invalid"


def json_values(stream: io.BufferedIOBase, most: int) -> Iterator[str]:
    """The texts of JSON values that white space separates, several in a line or one over several lines; each of up to ``most`` bytes."""
    reader, scan, text, at = io.TextIOWrapper(stream, "utf-8"), json.JSONDecoder().raw_decode, "", 0
    while True:
        at = SPACE.match(text, at).end()
        try:
            end = scan(text, at)[1] if at < len(text) else None
        except ValueError:
            end = None
        if end is not None and end < len(text):  # at the text's end a number may go on
            yield text[at:end]
            at = end
            continue
        more = reader.read(max(CHUNK, len(text) - at))
        if not more:
            if end is not None:
                yield text[at:end]
            elif text[at:].strip():
                raise ValueError("MalformedJSON")
            return
        text, at = text[at:] + more, 0
        if len(text) - len(more) > most:
            raise ValueError("OverMaxRecordSize")


def archive(raw: io.BufferedIOBase, seekable, prefix: str, content: bool) -> Iterator[tuple[str, int, bytes | None]]:
    """(member, size, content) of a zip or a tar, perhaps compressed, whose names begin with ``prefix``."""
    if raw.peek(4)[:2] == b"PK":
        with zipfile.ZipFile(seekable) as z:
            for i in z.infolist():
                if not i.is_dir() and i.filename.startswith(prefix):
                    yield i.filename, i.file_size, z.read(i) if content else None
    else:
        with tarfile.open(fileobj=opened(raw), mode="r|") as t:
            for m in t:
                if m.isfile() and m.name.startswith(prefix):
                    yield m.name, m.size, t.extractfile(m).read() if content else None


def valid_start(stream: io.BufferedIOBase, block: int) -> bool:
    """Whether the first ``block`` bytes are UTF-8; a character that the block cuts is read to its end."""
    data = stream.read(block + 3)
    for end in range(min(block, len(data)), len(data) + 1):
        try:
            data[:end].decode("utf-8")
            return True
        except UnicodeDecodeError as e:
            if e.end < end:  # not at the cut
                return False
    return False


class ObjectReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.kind, self.options = options["path"], options["kind"], options
        self.arrow = to_arrow_schema(schema)

    def number(self, name: str) -> int | None:
        return int(self.options[name]) if name in self.options else None

    def partitions(self) -> list[InputPartition]:
        store, root = store_of(self.path)
        info = store.get_file_info(root)
        found = [info] if info.is_file else store.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.base_name[0] not in "._")
        if self.kind != "range":
            return [Piece(path) for path, _ in files]
        pieces, step = [], self.number("piece") or 64 << 20
        for path, size in files:
            start, end = self.number("start"), self.number("end")
            a, b = (max(0, size - end), size) if start is None else (start, size if end is None else min(size, end + 1))
            cuts = [*range(a, b, step), b]
            pieces += [Piece(path, x, y, b, x == a) for x, y in zip(cuts[:-1], cuts[1:], strict=True) if x < y]
        return pieces

    def rows(self, p: Piece) -> Iterator[tuple]:
        store, _ = store_of(p.path)
        with store.open_input_file(p.path) as seekable:
            raw = io.BufferedReader(seekable, CHUNK)
            if self.kind == "range":
                yield from ((p.path, line) for line in self.slice(p, seekable))
            elif self.kind == "lines":
                yield from ((p.path, *x) for x in plain_lines(opened(raw)))
            elif self.kind == "values":
                yield from ((p.path, x) for x in json_values(opened(raw), self.number("most") or 10 << 20))
            elif self.kind == "check":
                yield p.path, valid_start(raw, self.number("block") or 128 << 10)
            else:
                content = self.kind == "members"
                yield from ((p.path, *x) if content else (p.path, *x[:2]) for x in archive(raw, seekable, self.options.get("prefix", ""), content))

    def slice(self, p: Piece, file) -> Iterator[str]:
        """Lines that begin in the piece; one that goes on behind it is read to its end, or the range's."""
        file.seek(p.start if p.first else p.start - 1)
        raw, at = io.BufferedReader(file, 1 << 16), p.start
        if not p.first:
            at += len(raw.readline()) - 1  # the line before it is the piece before's
        while at < p.end:
            line = raw.readline(p.until - at)
            if not line:
                return
            at += len(line)
            if line := line.rstrip(b"\n"):
                yield line.decode("utf-8", "replace")

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in self.rows(partition) if partition else ():
            rows.append(row)
            size += sum(len(x) for x in row if isinstance(x, str | bytes)) + 100
            if size > 4 << 20:
                yield self.batch(rows)
                rows, size = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.arrow, strict=True)], schema=self.arrow)


class ObjectSource(DataSource):
    """``kind`` says what is read of the objects: one of ``SCHEMAS``."""

    @classmethod
    def name(cls) -> str:
        return "tidewater_objects"

    def schema(self) -> str:
        return SCHEMAS[self.options["kind"]]

    def reader(self, schema: StructType) -> DataSourceReader:
        return ObjectReader(schema, dict(self.options))


def read_objects(spark: SparkSession, path: str, kind: str, **options: object) -> DataFrame:
    """What ``kind`` says of the object at ``path`` or of all objects under it; options that are None are left out."""
    spark.dataSource.register(ObjectSource)
    reader = spark.read.format("tidewater_objects").option("kind", kind)
    for name, x in options.items():
        if x is not None:
            reader = reader.option(name, str(x))
    return reader.load(path)
