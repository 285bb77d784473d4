"""The thin queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import bpe, brown, decontaminate, html, langid, secrets, simhash, suffixes, topk, warc
from tidewater.llm.common import fresh_path, written
from tidewater.session import table


PATTERN = public_tokenizers.PATTERN


def vocabulary() -> str:
    """The rank file that the queries and the pipeline encode with."""
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeated_passages(table(spark, sf_dir, "documents"))
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(c)
    return found.select("doc_id", "n_words", "n_repeated", shown("spans"), shown("later_spans"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(topk.quantised(table(spark, sf_dir, "embeddings")), "vectors")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary(), PATTERN)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.report(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identified(docs, langid.train(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_suffixes": op1_suffixes, "op2_topk": op2_topk, "op3_warc": op3_warc, "op4_bpe": op4_bpe, "op5_simhash": op5_simhash, "op6_decontaminate": op6_decontaminate, "op7_brown": op7_brown, "op8_secrets": op8_secrets, "op9_html": op9_html, "op10_langid": op10_langid}


#: Every stretch of 50 words, and the runs of those that another document has.
OP1_SQL = """
WITH texts AS (
  SELECT DISTINCT doc_id, list_filter(string_split_regex(text, '[ \\t-\\r]+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), stretches AS (
  SELECT doc_id, len(w) AS n_words, p, md5(array_to_string(w[p + 1:p + 50], ' ')) AS h FROM (SELECT *, unnest(range(len(w) - 49)) AS p FROM texts WHERE len(w) >= 50)
), shared AS (
  SELECT s.*, s.doc_id > low AS later FROM stretches s JOIN (SELECT h, min(doc_id) AS low, max(doc_id) AS high FROM stretches GROUP BY h) g ON s.h = g.h WHERE low <> high
), parts AS (SELECT doc_id, n_words, p, 0 AS part FROM shared UNION ALL SELECT doc_id, n_words, p, 1 FROM shared WHERE later
), cut AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id, part ORDER BY p) + 50 THEN 0 ELSE 1 END AS c FROM parts
), runs AS (SELECT *, sum(c) OVER (PARTITION BY doc_id, part ORDER BY p) AS run FROM cut
), spans AS (SELECT doc_id, n_words, part, min(p) AS a, max(p) + 50 AS b FROM runs GROUP BY doc_id, n_words, part, run)
SELECT doc_id, CAST(n_words AS INTEGER) AS n_words, CAST(sum(b - a) FILTER (WHERE part = 0) AS INTEGER) AS n_repeated,
       coalesce(string_agg(concat(a, ':', b), ',' ORDER BY a) FILTER (WHERE part = 0), '') AS spans,
       coalesce(string_agg(concat(a, ':', b), ',' ORDER BY a) FILTER (WHERE part = 1), '') AS later_spans
FROM spans GROUP BY doc_id, n_words
"""

OP2_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), vectors AS (SELECT vec_id, min(v) AS v FROM whole GROUP BY vec_id
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""


OP3_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM g
"""


#: All equal words of documents and items by diagonal, and the best window on each.
OP6_SQL = """
WITH d AS (
  SELECT doc_id, text, unnest(w) AS w, unnest(range(len(w))) AS p FROM (SELECT DISTINCT doc_id, text, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents)
), t AS (
  SELECT item_id, len(w) AS n, unnest(w) AS w, unnest(range(len(w))) AS q FROM (SELECT DISTINCT item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark)
), hits AS (
  SELECT doc_id, text, item_id, n, p - q AS diagonal, list(q ORDER BY q) AS qs FROM d JOIN t ON d.w = t.w GROUP BY doc_id, text, item_id, n, p - q HAVING count(*) >= ceil(0.8 * least(n, 13) - 1e-9)
), scored AS (
  SELECT *, list_max(list_transform(qs, lambda a: len(list_filter(qs, lambda b: b >= least(a, n - least(n, 13)) AND b < least(a, n - least(n, 13)) + least(n, 13))))) / least(n, 13) AS similarity FROM hits
)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_words, CAST(len(qs) AS INTEGER) AS n_found, similarity FROM scored WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY len(qs) DESC, similarity DESC) = 1
"""

OP8_RULES = [(r.kind, r.pattern.replace("((?i)", "((?i:").replace("api_?key)", "api_?key))"), r.group, r.least, r.inner) for r in secrets.RULES]


def _op8_spans(i: int, kind: str, pattern: str, group: int, least: int, inner: bool) -> str:
    q = pattern.replace("'", "''")
    n = "length(core[i])" if inner else "length(m[i])"
    return f"""
SELECT doc_id, {i} AS k, '{kind}' AS kind, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
    's': CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(m[1:i], lambda g: length(g))), 0) - {n} AS BIGINT),
    'n': {n}, 'core': length(core[i])}}), lambda x: x.core >= {least})) AS x
FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '{q}') AS gaps, regexp_extract_all(coalesce(text, ''), '{q}') AS m,
             regexp_extract_all(coalesce(text, ''), '{q}', {group}) AS core FROM documents WHERE regexp_matches(coalesce(text, ''), '{q}'))"""


OP8_SQL = f"""
WITH spans AS ({" UNION ALL ".join(_op8_spans(i, *r) for i, r in enumerate(OP8_RULES))}
), shown AS (SELECT doc_id, k, x.s AS s, concat(kind, ':', x.s, ':', x.s + x.n) AS span FROM spans
), by_doc AS (
  SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
         string_agg(span, ',' ORDER BY s, k) FILTER (WHERE k < 3) AS base, string_agg(span, ',' ORDER BY s, k) AS spans
  FROM shown GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN by_doc b ON d.doc_id = b.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffixes": OP1_SQL, "op2_topk": OP2_SQL, "op3_warc": OP3_SQL, "op6_decontaminate": OP6_SQL, "op8_secrets": OP8_SQL}
