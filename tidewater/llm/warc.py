"""WARC archives: records written by Spark's text writer and read by a Python data source.

Writing: a record is a string that Spark builds (header lines, a blank line, the block), and the text writer
puts the record end after each, so any store that Spark can write to will do. Of records with the same payload one
is a ``response`` and the others are ``revisit`` records, which carry the HTTP header but no payload.

Reading: format ``warc`` plans its partitions from files and their sizes. Predicates on the record's type and on
header columns are pushed down. A record's header is parsed first; if a predicate fails, its block is skipped by
seeking, and if no payload column is asked for, no payload is decoded.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith
from pyspark.sql.types import LongType, StructType

from tidewater.llm.common import if_small, written

RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are always written whole.
SMALL = 1000
#: Digests of repeated payloads that may be sent to every task, about 60 bytes each.
BROADCAST = 300_000

SCHEMA = (
    "record_id string, record_type string, target_uri string, record_date string, refers_to string, "
    "payload_digest string, content_type string, content_length long, headers map<string,string>, "
    "http_headers map<string,string>, payload binary"
)
#: Columns that are header fields of a record.
FIELDS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "record_date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
    "content_type": "content-type",
    "content_length": "content-length",
}


def with_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", small: int = SMALL) -> DataFrame:
    """``pages`` as (page_id, payload, bytes, digest, refers_to).

    refers_to is set on rows whose payload of at least ``small`` bytes a row of a larger page_id has too: the largest such.
    A null payload counts as empty. The largest id of each digest comes from a partial aggregate, and only digests
    of several rows are joined back, so a hot payload makes no large group. Up to ``BROADCAST`` such digests, which are
    counted first, are sent to the payloads; beyond that payloads and digests are dealt.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.select("page_id", "payload", F.octet_length("payload").cast("long").alias("bytes"), F.sha1(F.encode("payload", "UTF-8")).alias("digest"))
    large = rows.filter(F.col("bytes") >= small)
    last = large.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").select("digest", "last")
    last = if_small(written(last, "payloads"), BROADCAST)
    return rows.join(last, "digest", "left").select(
        "page_id", "payload", "bytes", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to")
    )


def write(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", uri: str = "urn:page:") -> None:
    """Write a record for each row of ``with_revisits`` to new files under ``path``."""
    name = lambda c: F.concat(F.lit(f"<{uri}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name("page_id"),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: {uri}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), name("refers_to"), F.lit(f"\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), length.cast("string"),
        F.lit("\r\n\r\n"), block,
    )
    records.select(record.alias("value")).write.option("lineSep", RECORD_END).text(path)


class Files(InputPartition):
    """Files that one task reads."""

    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


def _fields(lines: io.BufferedIOBase, limit: int | None = None) -> tuple[dict[str, str], int]:
    """Header fields up to the blank line, names in lower case, and the bytes read."""
    fields, read, last = {}, 0, None
    while limit is None or read < limit:
        line = lines.readline()
        read += len(line)
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            break
        if text[0] in " \t" and last:  # folded
            fields[last] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        fields[last := name.strip().lower()] = value.strip()
    return fields, read


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.path = options["path"]
        self.task_bytes = int(options.get("taskbytes", 64 << 20))
        self.names = schema.fieldNames()
        self.longs = {f.name for f in schema.fields if isinstance(f.dataType, LongType)}
        self.tests: list[tuple[str, str, object]] = []
        from pyspark.sql.pandas.types import to_arrow_schema

        self.arrow = to_arrow_schema(schema)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        kinds = {EqualTo: "eq", In: "in", StringStartsWith: "starts", IsNotNull: "there"}
        for f in filters:
            column = f.attribute[0] if type(f) in kinds and len(f.attribute) == 1 else None
            if column in FIELDS:
                self.tests.append((column, kinds[type(f)], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, root = _store(self.path)
        info = store.get_file_info(root)
        found = [info] if info.is_file else store.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        files = sorted(((f.path, f.size) for f in found if f.is_file and f.size and f.base_name[0] not in "._"), key=lambda x: x[0])
        tasks, size = [], 0
        for path, n in files:
            if not tasks or size + n > self.task_bytes:
                tasks.append([])
                size = 0
            tasks[-1].append(path)
            size += n
        return [Files(t) for t in tasks or [[]]]

    def wanted(self, row: dict) -> bool:
        for column, kind, value in self.tests:
            x = row[column]
            if x is None or kind == "eq" and x != value or kind == "in" and x not in value or kind == "starts" and not x.startswith(value):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with store.open_input_file(path) as raw:
                file = gzip.open(raw) if path.endswith(".gz") else io.BufferedReader(raw, 1 << 18)
                for row in self.records(file):
                    rows.append(row)
                    size += len(row.get("payload") or b"") + 500
                    if size > 4 << 20:
                        yield self.batch(rows)
                        rows, size = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        columns = [pa.array([r[n] for r in rows], f.type) for n, f in zip(self.names, self.arrow, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=self.arrow)

    def records(self, file: io.BufferedIOBase) -> Iterator[dict]:
        body = {"payload", "http_headers"} & {*self.names}
        while line := file.readline():
            if not line.startswith(b"WARC/"):
                continue  # blank lines between records
            headers, _ = _fields(file)
            row = {c: headers.get(h) for c, h in FIELDS.items()} | {"headers": headers, "http_headers": None, "payload": None}
            try:
                left = max(0, int(headers.get("content-length", "0")))
            except ValueError:
                left = None  # its end isn't known: the next record is where a line begins with the version
            row["content_length"] = left
            if left is None:
                if self.wanted(row):
                    yield row
                continue
            if self.wanted(row):
                if body:
                    if headers.get("content-type", "").startswith("application/http"):
                        left -= len(file.readline())  # the status line
                        row["http_headers"], read = _fields(file, left)
                        left -= read
                    if "payload" in body and row["record_type"] != "revisit":
                        row["payload"] = file.read(left)
                        left = 0
                yield row
            file.seek(left, io.SEEK_CUR)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; a schema of some of the columns reads only those."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(schema, {k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with its predicates pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def round_trip(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", small: int = SMALL) -> DataFrame:
    """Write ``pages`` as WARC files under ``path``, read them back, and report each record.

    One row per row of ``pages``: page_id, payload_bytes, payload_digest, record_type and refers_to. Bytes and digest
    of a response are measured on the payload that was read; those of a revisit are what its header says of the payload that it refers to.
    A null payload is an empty one. Rows that repeat the largest page_id of a payload are responses each.
    Null page_ids stay null and revisit any row that has an id. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    write(with_revisits(pages, id_col, payload_col, small), path)
    register(spark)
    back = spark.read.format("warc").schema("record_id string, record_type string, refers_to string, payload_digest string, http_headers map<string,string>, payload binary").load(path)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '(-?[0-9]+)>$', 1) AS bigint)")
    whole = F.col("record_type") == "response"
    return back.select(
        number("record_id").alias("page_id"),
        F.when(whole, F.octet_length("payload")).otherwise(F.col("http_headers")["content-length"].cast("long")).cast("long").alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        F.when(~whole, number("refers_to")).alias("refers_to"),
    )
