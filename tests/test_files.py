"""Readers on files that Spark did not write."""

import bz2
import gzip
import io
import struct
import tarfile
import zipfile
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from tidewater.sources import files, sinks


def put(path, data):
    path.write_bytes(data)
    return str(path)


def test_csv_modes(spark, tmp_path):
    p = put(tmp_path / "a.csv", b"id,x\n#note\n1,\"a,b\"\n2\n")
    assert [tuple(r) for r in files.read_csv(spark, p).collect()] == [("1", "a,b"), ("2", None)]
    assert files.read_csv(spark, p, "IGNORE").columns == ["_1", "_2"]
    assert files.read_csv(spark, p, "NONE").count() == 3
    q = put(tmp_path / "b.csv", b"id;x\r\n1;'it''s'\r\n")
    assert files.read_csv(spark, q, sep=";", quote="'", escape="'", record="\r\n").first().x == "it's"


def test_text_check(spark, tmp_path):
    put(tmp_path / "good", "é".encode())
    put(tmp_path / "bad", b"\xff\xfe")
    assert {r.path.rsplit("/", 1)[1]: r.valid for r in files.invalid_text(spark, str(tmp_path)).collect()} == {"good": True, "bad": False}


def test_compressed(spark, tmp_path):
    put(tmp_path / "a", gzip.compress(b"1\n") + gzip.compress(b"2\n3"))
    put(tmp_path / "b", bz2.compress(b"4\n5"))
    put(tmp_path / "c", zstandard.compress(b"6\n"))
    put(tmp_path / "d", gzip.compress(b"x" * 10000)[:-6])
    put(tmp_path / "e", b"plain")
    got = files.read_compressed(spark, str(tmp_path)).collect()
    by = {n: [(r.line, r.error) for r in got if r.path.endswith("/" + n)] for n in "abcde"}
    assert [x for x, _ in by["a"]] == ["1", "2", "3"] and [x for x, _ in by["b"]] == ["4", "5"] and by["c"] == [("6", None)] and by["e"] == [("plain", None)]
    assert by["d"][-1] == (None, "truncated")


def test_byte_ranges(spark, tmp_path):
    p = put(tmp_path / "r", b"abc\ndef\nghi\n")
    lines = lambda *a: [r.line for r in files.scan_range(spark, p, *a).collect()]
    assert lines(1, 5) == ["bc", "de"]
    assert lines(4, None) == ["def", "ghi"]
    assert lines(None, 5) == ["ghi"]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/1.txt", "one")
        z.writestr("y/2.txt", "two")
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as t:
        info = tarfile.TarInfo("x/3.txt")
        info.size = 5
        t.addfile(info, io.BytesIO(b"three"))
    put(tmp_path / "b.tar.gz", buffer.getvalue())
    got = files.archive_members(spark, str(tmp_path), "x/").orderBy("member").collect()
    assert [(r.member, r.size, bytes(r.content)) for r in got] == [("x/1.txt", 3, b"one"), ("x/3.txt", 5, b"three")]


def test_json_values(spark, tmp_path):
    p = put(tmp_path / "j", b'{"a": null, "b": 2}\n5\n"s"\n\n[1]\n')
    values = files.read_json(spark, p)
    assert values.count() == 4
    got = files.as_records(values).select(F.to_json("value")).collect()
    assert sorted(r[0] for r in got) == sorted(['{"a":null,"b":2}', '{"_1":5}', '{"_1":"s"}', '{"_1":[1]}'])


def test_parquet_leaves(spark, tmp_path):
    spark.sql("SELECT 1 AS id, named_struct('inner', 2, 'label', 'x') AS nested, array(1, 2) AS tags").write.parquet(str(tmp_path / "p"))
    row = files.read_parquet(spark, str(tmp_path / "p")).first()
    assert row.asDict() == {"id": 1, "nested.inner": None, "nested.label": None, "tags": [1, 2]}


def test_event_frames(spark):
    lines = spark.createDataFrame([("x" * 10,)] * 7, "line string").coalesce(1)
    got = sinks.event_stream(lines, 30).collect()
    assert [r.records for r in got] == [2, 2, 2, 1]
    for r in got:
        m = bytes(r.message)
        total, head = struct.unpack(">II", m[:8])
        assert total == len(m) and struct.unpack(">I", m[8:12])[0] == zlib.crc32(m[:8]) and struct.unpack(">I", m[-4:])[0] == zlib.crc32(m[:-4])
        assert m[12 + head : -4] == b"xxxxxxxxxx\n" * r.records


def test_long_record_ends_and_headers(spark, tmp_path):
    for name in "ab":
        put(tmp_path / name, b'"k,1",v;;;1,2;;;"k,1",v;;;3,"x;;y"')
    got = files.read_csv(spark, str(tmp_path), record=";;;")
    assert got.columns == ["k,1", "v"]
    assert sorted(tuple(r) for r in got.collect()) == sorted([("1", "2"), ("k,1", "v"), ("3", "x;;y")] * 2)
    assert files.read_csv(spark, str(tmp_path), "IGNORE", record=";;;").columns == ["_1", "_2"]
    assert files.read_csv(spark, str(tmp_path), "NONE", record=";;;").count() == 8


def test_text_check_at_the_block_end(spark, tmp_path):
    cases = {"cut": b"x" + "é".encode() * 40, "short": "é".encode()[:1], "late": b"x" * 50 + b"\xff", "at": b"x" * 31 + b"\xff" + b"x" * 9, "four": b"xyz" + "😀".encode() * 9, "broken": b"x" * 31 + b"\xc3" + b"x" * 9}
    for name, data in cases.items():
        put(tmp_path / name, data)
    got = {r.path.rsplit("/", 1)[1]: r.valid for r in files.invalid_text(spark, str(tmp_path), 32).collect()}
    assert got == {"cut": True, "short": False, "late": True, "at": False, "four": True, "broken": False}


def test_ranges_cut_characters_and_pieces(spark, tmp_path):
    data = "éa\nbé\n\nccc\ndd".encode()
    p = put(tmp_path / "r", data)
    for start in range(len(data)):
        for end in range(start, len(data) + 2):
            if (start * 7 + end) % 5 == 0:
                want = [x.decode("utf-8", "replace") for x in data[start : end + 1].split(b"\n") if x]
                for piece in (1, 3, 100):
                    assert [r.line for r in files.scan_range(spark, p, start, end, piece).collect()] == want, (start, end, piece)
    assert [r.line for r in files.scan_range(spark, p, 99, None).collect()] == []


def test_separated_json(spark, tmp_path):
    p = put(tmp_path / "j", b'{"a":1} {"a":\n2}[3]\t4 5\n"six" null\n\n 7.5e1')
    got = [r.raw for r in files.read_json(spark, p, separated=True).collect()]
    assert got == ['{"a":1}', '{"a":\n2}', "[3]", "4", "5", '"six"', "null", "7.5e1"]
    q = put(tmp_path / "k", b'{"a":1} {"a"')
    with pytest.raises(Exception, match="MalformedJSON"):
        files.read_json(spark, q, separated=True).collect()
    long = put(tmp_path / "l", b'{"a":"' + b"x" * 3_000_000 + b'"} 1')
    assert files.read_json(spark, long, separated=True).count() == 2
    for options in ({"separated": True, "most": 1000}, {"document": True, "most": 1000}):
        with pytest.raises(Exception, match="OverMaxRecordSize"):
            files.read_json(spark, long, **options).collect()


def test_error_frame(spark):
    df = spark.createDataFrame([(sinks.error_frame("InvalidQuery", "no such column"),), (sinks.frame({":event-type": "Cont"}, b""),)], "message binary")
    assert [(r.type, bytes(r.payload)) for r in sinks.parse_frames(df).collect()] == [("InvalidQuery", b""), ("Cont", b"")]


def test_listing_an_archive_reads_names_alone(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/", "")
        z.writestr("x/1.txt", "one" * 1000)
    assert [(r.member, r.size) for r in files.list_archive(spark, str(tmp_path)).collect()] == [("x/1.txt", 3000)]
