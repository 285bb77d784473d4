"""Writers: CSV and JSON records as text, numbers as text, framed event streams, notification logs, report exports."""

from __future__ import annotations

import io
import json
import struct
import tarfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_line(*fields: Column, sep: str = ",", quote: str = '"', escape: str | None = None, always: bool = False) -> Column:
    """One CSV record: a field is quoted if it holds the delimiter, the quote, a line break or a leading space, or is ``\\.``."""
    esc = escape or quote

    def one(x: Column) -> Column:
        x = F.coalesce(x.cast("string"), F.lit(""))
        quoted = F.concat(F.lit(quote), F.replace(x, F.lit(quote), F.lit(esc + quote)), F.lit(quote))
        if always:
            return quoted
        needs = x.contains(sep) | x.contains(quote) | x.contains("\n") | x.contains("\r") | x.startswith(" ") | (x == "\\.")
        return F.when(needs, quoted).otherwise(x)

    return F.concat_ws(sep, *[one(f) for f in fields])


def float_json(x: Column) -> Column:
    """A float as JSON text: an exponent only under 1e-6 and from 1e21 on; what JSON has no number for is null."""
    text = x.cast("string")  # the shortest digits, perhaps with an exponent
    mantissa, power = F.split_part(text, F.lit("E"), F.lit(1)), F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int")
    digits = F.rtrim(F.regexp_replace(mantissa, r"[-.]", ""), F.lit("0"))
    sign = F.when(mantissa.startswith("-"), "-").otherwise("")
    plain = F.regexp_replace(mantissa, r"\.0$", "")
    n = F.length(digits)
    big = F.when(n > power + 1, F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2))).otherwise(F.rpad(digits, power + 1, "0"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    wide = F.concat(plain, F.lit("e"), F.when(power > 0, "+").otherwise(""), power.cast("string"))
    special = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(special, "null").when(x == 0, "0").when(power.isNull(), plain).when((power >= 21) | (power < -6), wide).when(power > 0, F.concat(sign, big)).otherwise(F.concat(sign, small))


def float_g(x: Column) -> Column:
    """A float in the shortest form, with an exponent of two digits or more under 1e-4 and from 1e6 on; NaN, +Inf and -Inf by name."""
    text = x.cast("string")
    special = F.isnan(x) | (F.abs(x) == float("inf"))
    whole = F.when(~special & (x != 0), F.abs(x))
    mantissa = F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), r"\.0$", "")
    digits = F.regexp_replace(F.regexp_replace(text, "E.*$", ""), r"[-.]", "")
    power = F.floor(F.log10(whole)).cast("int")
    lead = F.regexp_replace(F.regexp_replace(digits, "^0+", ""), "0+$", "")
    body = F.when(F.length(lead) > 1, F.concat(F.substr(lead, F.lit(1), F.lit(1)), F.lit("."), F.substr(lead, F.lit(2)))).otherwise(lead)
    sign = F.when(x < 0, "-").otherwise("")
    exponent = F.concat(F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), "0"))
    named = F.when(F.isnan(x), "NaN").when(x > 0, "+Inf").otherwise("-Inf")
    return F.when(special, named).when(x == 0, "0").when((whole < 1e-4) | (whole >= 1e6), F.concat(sign, body, F.lit("e"), exponent)).otherwise(
        F.when(text.contains("E"), float_json(x)).otherwise(mantissa)
    )


def json_record(fields: list[tuple[str, Column]]) -> Column:
    """One JSON record, keys in order and as often as they come; NULL as null."""
    parts = []
    for name, x in fields:
        parts.append(F.concat(F.lit(json.dumps(name, ensure_ascii=False)), F.lit(":"), F.coalesce(x, F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_line(**fields: Column) -> Column:
    """One JSON record, keys in order; floats in their JSON text, NULL as null."""
    return json_record(list(fields.items()))


def json_text(x: Column) -> Column:
    """A text as a JSON string."""
    wrapped = F.to_json(F.array(x))
    return F.when(x.isNotNull(), wrapped.substr(F.lit(2), F.length(wrapped) - 2))


def guarded(line: Column, most: int = 1 << 20) -> Column:
    """A record, or an error if it is longer than ``most`` bytes."""
    return F.when(F.octet_length(line) > most, F.raise_error(F.lit("OverMaxRecordSize"))).otherwise(line)


def frame(headers: dict[str, str], payload: bytes) -> bytes:
    """One message of an event stream: lengths, their CRC, headers, payload, CRC of all."""
    named = b"".join(bytes([len(k)]) + k.encode() + b"\x07" + struct.pack(">H", len(v.encode())) + v.encode() for k, v in headers.items())
    prelude = struct.pack(">II", len(named) + len(payload) + 16, len(named))
    body = prelude + struct.pack(">I", zlib.crc32(prelude)) + named + payload
    return body + struct.pack(">I", zlib.crc32(body))


def event_stream(lines: DataFrame, most: int = 128 << 10) -> DataFrame:
    """(message): the records (line) of each partition packed into messages of up to ``most`` bytes."""
    headers = {":message-type": "event", ":event-type": "Records", ":content-type": "application/octet-stream"}
    schema = pa.schema([("message", pa.binary()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, n = bytearray(), 0
        for batch in batches:
            for line in batch.column(0).to_pylist():
                data = line.encode() + b"\n"
                if packed and len(packed) + len(data) > most:
                    yield pa.RecordBatch.from_pylist([{"message": frame(headers, bytes(packed)), "records": n}], schema=schema)
                    packed, n = bytearray(), 0
                packed += data
                n += 1
        if packed:
            yield pa.RecordBatch.from_pylist([{"message": frame(headers, bytes(packed)), "records": n}], schema=schema)

    return lines.select("line").mapInArrow(run, "message binary, records long")


def stats(records: DataFrame, scanned: Column, processed: Column, returned: Column) -> DataFrame:
    """(bytes_scanned, bytes_processed, bytes_returned): the sums over the records of a response; 0 for none."""
    total = lambda x, name: F.coalesce(F.sum(x), F.lit(0)).cast("bigint").alias(name)
    return records.agg(total(scanned, "bytes_scanned"), total(processed, "bytes_processed"), total(returned, "bytes_returned"))


def stats_xml(tag: str = "Stats") -> Column:
    """The payload of a Stats or Progress message from the columns of ``stats``."""
    one = lambda name, c: F.concat(F.lit(f"<{name}>"), F.col(c).cast("string"), F.lit(f"</{name}>"))
    inner = F.concat(one("BytesScanned", "bytes_scanned"), one("BytesProcessed", "bytes_processed"), one("BytesReturned", "bytes_returned"))
    return F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><{tag}>'), inner, F.lit(f"</{tag}>"))


def closing_frames(of: DataFrame) -> DataFrame:
    """(message) of the Stats and the End message that close a response, from the one row of ``stats``."""
    schema = pa.schema([("message", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for xml in batch.column(0).to_pylist():
                closing = frame({":message-type": "event", ":content-type": "text/xml", ":event-type": "Stats"}, xml.encode())
                end = frame({":message-type": "event", ":event-type": "End"}, b"")
                yield pa.RecordBatch.from_arrays([pa.array([closing, end], pa.binary())], schema=schema)

    return of.select(stats_xml().alias("xml")).mapInArrow(run, "message binary")


def error_frame(code: str, message: str) -> bytes:
    """The message that ends a response that failed."""
    return frame({":message-type": "error", ":error-message": message, ":error-code": code}, b"")


def parse_frames(messages: DataFrame) -> DataFrame:
    """(type, payload) of messages: the event type, or the error's code."""
    schema = pa.schema([("type", pa.string()), ("payload", pa.binary())])

    def one(data: bytes) -> tuple[str, bytes]:
        total, head = struct.unpack(">II", data[:8])
        if total != len(data) or zlib.crc32(data[:-4]) != struct.unpack(">I", data[-4:])[0]:
            raise ValueError("a damaged message")
        named, at = {}, 12
        while at < 12 + head:
            key = data[at + 1 : (at := at + 1 + data[at])].decode()
            size = struct.unpack(">H", data[at + 1 : at + 3])[0]
            named[key] = data[at + 3 : (at := at + 3 + size)].decode()
        return named.get(":event-type") or named.get(":error-code"), data[12 + head : -4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(m) for m in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([p for _, p in found], pa.binary())], schema=schema)

    return messages.select("message").mapInArrow(run, "type string, payload binary")


def write_archives(members: DataFrame, path: str, kind: str = "zip") -> DataFrame:
    """Write each partition of (member, content) as one archive under ``path``: zip, or tar with gzip. Returns (path, members)."""
    from tidewater.sources.objects import store_of

    schema = pa.schema([("path", pa.string()), ("members", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(path)
        store.create_dir(root)
        name, n = f"{root}/{uuid.uuid4().hex}.{'zip' if kind == 'zip' else 'tar.gz'}", 0
        with store.open_output_stream(name, compression=None) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) if kind == "zip" else tarfile.open(fileobj=out, mode="w|gz") as archive:
            for batch in batches:
                for member, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    data, n = content.as_py(), n + 1
                    if kind == "zip":
                        archive.writestr(member, data)
                    else:
                        info = tarfile.TarInfo(member)
                        info.size = len(data)
                        archive.addfile(info, io.BytesIO(data))
        yield pa.RecordBatch.from_pylist([{"path": name, "members": n}], schema=schema)

    return members.select("member", F.col("content").cast("binary").alias("content")).mapInArrow(run, "path string, members long")


def append_log(events: DataFrame, path: str) -> None:
    """The access format of notifications: a row for each event, appended."""
    events.write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """A report as one CSV file with a header. Reports are aggregates; for a large table write without this."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
