"""From raw documents to training tokens, in five stages.

Each stage takes what the one before kept, as written Parquet, and its decisions take effect:

1. language ID: documents without a language that is told with some certainty go;
2. SimHash near-dedup: one document of each group stays;
3. benchmark decontamination: documents that hold an item of ``benchmark`` go;
4. secret scans: documents with a secret go;
5. byte-level BPE: each text becomes its ids, decoded again as a check.

Stages 1 to 4 return the columns of ``documents``; the last returns doc_id, n_tokens, ids_sha256, decoded_sha256 and ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import bpe, decontaminate, langid, secrets, simhash
from tidewater.llm.common import written
from tidewater.llm.queries import PATTERN, vocabulary
from tidewater.session import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.kept(docs, langid.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.without_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, vocabulary(), PATTERN, keep_ids=True)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", drop_secrets),
    ("byte-level BPE", encode),
]

#: A network and connected components are not for SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i + 1}")
    return docs
