"""SimHash near-duplicate groups, with links found by deletion-variant signatures.

A text's fingerprint has 64 bits. Two fingerprints that differ in at most two bits are linked. Cut into two
segments of 32 bits, one segment of such a pair differs in at most one bit. So every distinct fingerprint is
indexed under each of its one-wildcard segment variants: (segment, wildcard bit, the other 31 bits). Pairs that
share a variant are verified on all 64 bits.

Distinct fingerprints may be crowded (thousands of light edits of one text share a segment), and then a variant's
bucket would hold a square number of pairs. A bucket of up to ``BUCKET`` fingerprints is verified pair by pair.
The fingerprints of larger ones take an exact way without pairs: the wildcard runs over the whole fingerprint,
and everything within one bit of a centre is linked to the smallest fingerprint around that centre. Members of one
centre differ in at most two bits, and any two fingerprints that differ in at most two bits have a common centre, so no
link is lost and none is made up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import written
from tidewater.llm.components import connected_components

SEED = 42
SHINGLE = 3
#: Fingerprints in a variant's bucket up to which its pairs are verified one by one.
BUCKET = 16
DISTANCE = 2


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint as an unsigned int; zero where there is no word."""
    words = (text or b"").lower().split()  # bytes: only A-Z is lowered and only ASCII white space splits
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.array([digest(g, SEED) for g in grams], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 8192):
        part = hashes[i : i + 8192]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def row_key(doc_id: Column, text: Column) -> Column:
    """What stands for a row's id and whole text."""
    return F.xxhash64(doc_id.isNull(), doc_id, text.isNull(), text, F.length(text))


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """(id, fp), and row_key if ``keyed``: fp is the fingerprint as a signed long. Texts are read whole; nothing is shuffled."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), *[("row_key", pa.int64())] * keyed])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], schema=schema)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if keyed:
        return source.withColumn("row_key", row_key(F.col("doc_id"), F.col("text"))).mapInArrow(run, "doc_id long, fp long, row_key long")
    return source.mapInArrow(run, "doc_id long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that connect everything within two bits.

    ``fps`` has one column ``fp`` of distinct values. Pairs of sparse variants are all there; crowded ones
    are given as stars, which connect the same fingerprints.
    """
    shift = lambda c, n: F.shiftrightunsigned(c, n)
    # One long for a variant: 31 bits, then the wildcard's place and the segment.
    index = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("w")).select(
        "fp",
        (
            F.expr("shiftright(w, 5) * 32 + (w & 31)").cast("long") * F.lit(1 << 32)
            + F.expr("shiftrightunsigned(fp, shiftright(w, 5) * 32) & 4294967295L & ~shiftleft(1L, w & 31)")
        ).alias("variant"),
    )
    groups = index.groupBy("variant").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    groups = written(groups.filter("n > 1"), "simhash-variants")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    pairs = groups.filter("n = 2").select("a", "b")
    # The merge join deals both sides alike at every size, and Spark splits a hot variant's partition.
    some = index.join(groups.filter(F.col("n") > 2).select("variant", "n").hint("merge"), "variant")
    few = some.filter(F.col("n") <= BUCKET).select("variant", "fp")
    few_pairs = few.alias("x").join(few.alias("y"), "variant").filter("x.fp < y.fp").select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    found = pairs.unionByName(few_pairs).filter(close)

    crowded = some.filter(F.col("n") > BUCKET).select("fp").distinct()
    centres = crowded.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("w")).select(
        "fp", F.expr("CASE WHEN w = 64 THEN fp ELSE fp ^ shiftleft(1L, w) END").alias("centre")
    )
    centres = written(centres, "simhash-centres")
    star = centres.groupBy("centre").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = centres.join(star, "centre").filter("fp <> a").select("a", F.col("fp").alias("b"))
    return found.unionByName(stars).distinct()


def _rooted(fps: DataFrame, least: Column) -> DataFrame:
    """(fp, least, root) for each distinct fingerprint: an aggregate of its rows, and its component's smallest fingerprint."""
    distinct = written(fps.groupBy("fp").agg(least.alias("least")), "simhash-distinct")
    roots = connected_components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hexadecimal digits) and component_id.

    component_id is the smallest doc_id that links of at most two differing bits reach. Null and empty texts
    have fingerprint zero and are linked like any other. Repeated rows give repeated rows. A null doc_id
    keeps its row; its component has the smallest doc_id among the others, or null if there is none. Other
    columns of ``docs``, whatever their names, are not read. An empty table gives an empty result.
    """
    fps = written(with_fingerprints(docs, id_col, text_col), "simhash-fps")
    rooted = _rooted(fps, F.min("doc_id"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(component, "root").select("fp", "component_id")
    return fps.join(labels, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, and among texts that share it of the smallest key.

    Rows go by their id and text together, so texts of different components stay though they share a doc_id or have none. Rows without
    a doc_id come last: one stays if its component has no other. Null and empty texts are one component with whatever
    else has fingerprint zero. Of rows that repeat both, one stays. Columns stay as they are; an empty table stays empty.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key"))
    rooted = _rooted(written(with_fingerprints(docs, keyed=True), "simhash-fps"), first)
    keep = rooted.groupBy("root").agg(F.min("least").alias("least"))
    own = next(name for i in range(len(docs.columns) + 1) if (name := f"row_key_{i}") not in docs.columns)
    # Both the join and the repeated rows go by one key, so that texts are dealt once.
    keyed = docs.withColumn(own, row_key(docs["doc_id"].cast("long"), docs["text"].cast("string")))
    return keyed.join(keep.select(F.col("least.row_key").alias(own)), own, "left_semi").dropDuplicates([own]).select(docs.columns)
