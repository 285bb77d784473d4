"""The filtering forms on odd rows: nulls in every column, long and empty texts, repeated rows, clashing names, nothing at all."""

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, component_id string, bad_blob string, leaked_id long, words string, kind boolean"


def rows(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    english = "the cat and the dog are in the house with all of the others and that is for the best "
    texts = [english, english, None, "", "1 2 3", english * 3000, item + " " + english[:20], "la maison est dans le jardin avec les autres et pour les enfants", "token = abcdef123456 " + english, english.upper()]
    out = [(i, t, "en", f"s{i}", len(t or ""), i, "x", "y", 0, "z", True) for i, t in enumerate(texts)]
    return [*out, out[7], (None, "un autre texte dans la langue avec les mots pour tous", None, None, None, None, None, None, None, None, None)]


@pytest.mark.parametrize("k", range(4))
def test_stage_keeps_columns(spark, k):
    docs = spark.createDataFrame(rows(spark), SCHEMA)
    got = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    gone = {0: {2, 3, 4}, 1: {1, 3, 9}, 2: {6}, 3: {8}}[k]
    assert not gone & set(ids), ids
    assert {0, 5} <= set(ids) or k == 1
    assert ids.count(7) == (1 if k == 1 else 2)
    assert None in ids  # a text of its own stays though it has no id
    empty = corpus_pipeline.STAGES[k][1](spark, docs.limit(0), SF)
    assert empty.columns == docs.columns and empty.count() == 0


def test_last_stage(spark):
    docs = spark.createDataFrame(rows(spark), SCHEMA)
    assert corpus_pipeline.encode(spark, docs, SF).count() == docs.count()
    assert corpus_pipeline.encode(spark, docs.limit(0), SF).count() == 0
