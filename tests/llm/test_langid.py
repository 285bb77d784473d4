import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import langid

DOCS = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def trained(spark):
    return langid.train(spark.read.parquet(DOCS))


def test_held_out_accuracy(spark, trained):
    docs = spark.read.parquet(DOCS)
    got = langid.identified(docs, trained).join(docs, "doc_id").toPandas()
    want = got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)
    assert (got.held_out == want).all()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_same_sample_same_network(spark, trained):
    again = langid.train(spark.read.parquet(DOCS).repartition(7))
    assert np.array_equal(again.weights, trained.weights)


def test_only_text_counts(spark, trained):
    docs = spark.read.parquet(DOCS).limit(50)
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y")).withColumn("doc_id", F.col("doc_id") + 10**6)
    a, b = (langid.identified(d, trained).toPandas().sort_values("doc_id") for d in (docs, other))
    assert a.lang_pred.tolist() == b.lang_pred.tolist()


def test_gradients():
    rng = np.random.default_rng(0)
    net = langid.fit(["abc de", "xyz uv"] * 3, ["a", "b"] * 3, epochs=1)
    x, y = rng.integers(97, 120, (5, 20)), np.array([0, 1, 0, 1, 1])
    grads = langid._gradients(net, x, y, np.ones(5, np.float32))
    for p, g in zip([*net.filters, net.bias, net.weights, net.offset], grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        p64, keep = [], p[at]
        for e in (1e-2, -1e-2):
            p[at] = keep + e
            p64.append(-net.log_probabilities(x)[np.arange(5), y].mean())
        p[at] = keep
        assert (p64[0] - p64[1]) / 2e-2 == pytest.approx(g[at], rel=0.2, abs=1e-3)


def test_odd_rows(spark, trained):
    rows = [(1, None, "a"), (2, "", None), (3, "123 !!", "c"), (None, "the of and " * 60_000, "d"), (4, "the", "e"), (4, "the", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = langid.identified(df, trained).toPandas()
    assert got.columns.tolist() == ["doc_id", "held_out", "lang_pred", "score"]
    assert got.lang_pred.tolist()[:3] == ["und"] * 3 and got.score.tolist()[:3] == [0, 0, 0]
    assert got.lang_pred.tolist()[3] == "en" and not got.held_out.tolist()[3]
    assert langid.identified(df.limit(0), trained).count() == 0
    nothing = langid.train(spark.read.parquet(DOCS).limit(0))
    assert langid.identified(df, nothing).toPandas().lang_pred.tolist() == ["und"] * 6
    assert [r.doc_id for r in langid.kept(df, trained, 0.0).collect()] == [None, 4, 4]


def test_cut_takes_whole_windows():
    text = bytes(range(256)) * 20
    got = langid.cut(text)
    assert len(got) == langid.WINDOWS * langid.WINDOW and got == langid.cut(text)
    assert all(got[i : i + langid.WINDOW] in text for i in range(0, len(got), langid.WINDOW))
    assert langid.cut(b"abc") == b"abc" and langid.cut(b"") == b""
    assert langid.cut(text[:200]) == text[:192]


def test_every_label_can_be_predicted(spark):
    rows = [(i * 1000 + k, chr(0x4E00 + i) * 60, f"l{i}") for i in range(520) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(df)
    assert len(net.languages) == len({r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2})


def test_repeated_rows_do_not_swell_the_sample(spark):
    df = spark.range(20_000).select(F.lit(8).cast("long").alias("doc_id"), F.lit("the same words again").alias("text"), F.lit("en").alias("lang"))
    seen = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(langid, "fit", lambda texts, labels: seen.append(len(texts)))
        for sample in (400, 30_000):
            langid.train(df, sample=sample)
    assert seen[0] <= 800 and seen[1] == 20_000
