import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import test_bpe, test_decontaminate, test_secrets, test_simhash
from tidewater.llm import langid
from tidewater.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(2).select(F.col("doc_id") + 10**6, F.lit("123 456").alias("text"), "lang", "source", "n_chars")
    docs = written(docs.union(extra), "docs")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = written(stage(spark, docs, SF), "stage")
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.count() == len(after)
        seen[name] = (before, after)
    before, after = seen["language ID"]
    names, scores = langid.predict(langid.train(spark.createDataFrame(list(before.items()), "doc_id long, text string").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id", "left")), list(before.values()))
    assert set(after) == {i for i, n, s in zip(before, names, scores, strict=True) if n != "und" and s >= 0.3}
    assert not {i for i in after if i >= 10**6} and len(after) > 0.98 * (len(before) - 2)
    before, after = seen["SimHash near-dedup"]
    roots = test_simhash.plain_components({i: test_simhash.plain_fingerprint(t) for i, t in before.items()}, test_simhash.two_bits)
    assert set(after) == set(roots.values())
    before, after = seen["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(before) - set(after) == {i for i, _ in test_decontaminate.plain(list(before.items()), items)}
    before, after = seen["secret scans"]
    assert set(before) - set(after) == {i for i, t in before.items() if test_secrets.plain(t)[4]}

    got = {r.doc_id: r for r in corpus_pipeline.encode(spark, docs, SF).collect()}
    oracle = test_bpe.library_encoding()
    assert set(got) == set(after)
    assert all(got[i].ids == oracle.encode_ordinary(t) for i, t in after.items())


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = got.join(docs, "doc_id").select("decoded_sha256", F.sha2(F.encode("text", "UTF-8"), 256).alias("want")).collect()
    assert 0 < len(rows) < docs.count()
    assert all(r.decoded_sha256 == r.want for r in rows)
    assert P.PATTERN == corpus_pipeline.PATTERN
