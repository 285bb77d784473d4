import gzip
import hashlib

from pyspark.sql import functions as F

from tidewater.llm import warc
from tidewater.llm.common import fresh_path


def pages(spark):
    big, other = "é<p>x</p>\r\n\r\nWARC/1.1\r\n" * 100, "y" * 1000
    rows = [(1, big), (2, big), (9, big), (3, other), (4, "short"), (5, "short"), (6, None), (7, ""), (None, big), (9, big), (8, other[:-1]), (11, other[:-1])]
    return spark.createDataFrame([(i, h, "clash") for i, h in rows], "page_id long, html string, payload string"), rows


def plain(rows):
    out = []
    for i, html in rows:
        data = (html or "").encode()
        same = [j for j, h in rows if j is not None and (h or "").encode() == data]
        top = max(same) if len(data) >= 1000 and len([1 for _, h in rows if h == html]) > 1 else None
        refers = top if top is not None and i != top else None
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_round_trip(spark):
    df, rows = pages(spark)
    got = warc.round_trip(df, fresh_path(spark, "warc"))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)
    assert warc.round_trip(df.limit(0), fresh_path(spark, "warc")).count() == 0


def test_predicates_skip_blocks(spark, tmp_path):
    df, _ = pages(spark)
    path = fresh_path(spark, "warc")
    warc.write(warc.with_revisits(df), path)
    warc.register(spark)
    read = spark.read.format("warc").load(path)
    assert read.filter("record_type = 'revisit'").count() == 3
    assert read.filter("record_type = 'revisit' AND payload IS NOT NULL").count() == 0
    assert read.filter(F.col("target_uri").isin("urn:page:4", "urn:page:5")).select(F.decode("payload", "UTF-8")).collect()[0][0] == "short"
    assert read.filter("target_uri LIKE 'urn:page:1%'").count() == 2
    assert "record_type" in read.filter("record_type = 'revisit'")._jdf.queryExecution().toString()
    reader = warc.WarcReader(read.schema, {"path": path})
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload",), b"")])) == [warc.EqualTo(("payload",), b"")]
    assert len([r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]) == 3


def test_foreign_gzip_file(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nX-Long: a\r\n b\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    with open(tmp_path / "a.warc.gz", "wb") as f:
        f.write(gzip.compress(record) + gzip.compress(record.replace(b"warcinfo", b"metadata")))
    warc.register(spark)
    got = spark.read.format("warc").load(str(tmp_path)).filter("record_type = 'metadata'").collect()
    assert [(bytes(r.payload), r.headers["x-long"], r.content_length) for r in got] == [(b"abc", "a b", 3)]


def test_broken_length(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: %s\r\nContent-Length: %s\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record % (b"metadata", b"three") + record % (b"resource", b"3") + record % (b"warcinfo", b"-1"))
    warc.register(spark)
    got = spark.read.format("warc").load(str(tmp_path)).collect()
    assert [(r.record_type, r.content_length, r.payload and bytes(r.payload)) for r in got] == [("metadata", None, None), ("resource", 3, b"abc"), ("warcinfo", 0, b"")]
