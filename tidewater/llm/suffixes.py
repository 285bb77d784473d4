"""Repeated passages across documents, by sparse suffix arrays.

A passage counts as repeated if it has ``LENGTH`` words or more and another document has it word for word. Words
are what white space separates.

Only the suffixes at minimiser positions are kept: of every ``WINDOW`` neighbouring groups of ``GRAM`` words, the one with
the least hash. Equal passages have equal minimisers, so every repeated passage of ``LENGTH`` words has a kept
position from which LENGTH - WINDOW + 1 words lie inside it. The kept suffixes are sorted by the hash of those words over
all documents, and neighbours are compared: suffixes without an equal neighbour in another text fall away.
Around the others the match is extended left and right: every stretch of LENGTH words that holds the suffix's head at an
offset that the minimiser allows is hashed, and again sorted and compared with its neighbours. Each stretch that another
text has gets a witness there, and stretches that follow each other in both texts grow into one match, as far left and right
as it goes. Then the words of every match are compared with its witness's. Where they differ, the hash was the
same by chance, and the stretches of that hash are grouped by their words. So hashes only choose what is compared.

Sorting by range splits a passage that a third of the documents share over as many partitions as its rows need;
only a few rows at each partition's edges are settled afterwards. Exact copies count as one text in all steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import if_small, written

LENGTH = 50
WINDOW = 20
GRAM = 4

#: Keys at partition edges that are broadcast; there are two to a partition at most.
EDGES = 1 << 17

ROWS = "key long, doc long, text_key long, pos int"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Hashes:
    """Hashes of any stretch of a text's words, by differences of sums of powers modulo 2 to the 64."""

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        digest = xxhash.xxh64_intdigest
        one = np.fromiter(map(digest, words), dtype=np.uint64, count=self.n)
        with np.errstate(over="ignore"):
            powers = _powers(_BASE, self.n)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(one * powers, dtype=np.uint64)])
            self.back = _powers(_INVERSE, self.n)

    def of(self, starts: np.ndarray, length: int) -> np.ndarray:
        """The hash of ``length`` words from each start on."""
        with np.errstate(over="ignore"):
            x = (self.sums[starts + length] - self.sums[starts]) * self.back[starts]
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return (x ^ (x >> np.uint64(31))).view(np.int64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(1, n), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


def minimisers(hashes: Hashes, length: int, window: int, gram: int) -> np.ndarray:
    """The kept positions of a text: the leftmost least gram of each window of grams."""
    if hashes.n < length:
        return np.zeros(0, dtype=np.int64)
    grams = hashes.of(np.arange(hashes.n - gram + 1), gram)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    places = np.unique(views.argmin(axis=1) + np.arange(len(views)))
    return places[places + length - window + 1 <= hashes.n]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, text) of the rows with an id and a text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text", F.length("text")).alias("text_key"), "text")


def _suffixes(texts: DataFrame, length: int, window: int, gram: int, mask: int) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("text_key", pa.int64()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys, owners, places = [], [], []
                for owner, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    hashes = Hashes(text.split())
                    place = minimisers(hashes, length, window, gram)
                    if len(place):
                        keys.append(hashes.of(place, length - window + 1) & mask)
                        owners.append(np.full(len(place), owner))
                        places.append(place.astype(np.int32))
                if keys:
                    owner = pa.array(np.concatenate(owners))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), owner, owner, pa.array(np.concatenate(places))], schema=schema)

    return texts.select("text_key", "text").mapInArrow(run, ROWS)


def _stretches(texts: DataFrame, length: int, window: int, mask: int) -> DataFrame:
    """Extend: (hash, doc, text_key, place) of all stretches of ``length`` words around the kept positions of each text."""
    schema = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("text_key", pa.int64()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc, owner, text, places = (batch.column(i)[row] for i in range(4))
                hashes = Hashes(text.cast(pa.binary()).as_py().split())
                kept = places.values.to_numpy().astype(np.int64)
                near = np.zeros(hashes.n, dtype=bool)
                for k in range(window):
                    near[np.maximum(kept - k, 0)] = True
                starts = np.flatnonzero(near[: hashes.n - length + 1])
                if len(starts):
                    same = [pa.array(np.full(len(starts), x.as_py())) for x in (doc, owner)]
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.of(starts, length) & mask), *same, pa.array(starts.astype(np.int32))], schema=schema)

    return texts.select("doc", "text_key", "text", "places").mapInArrow(run, ROWS)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare neighbours in a partition that is sorted by key, doc, text_key and pos.

    kind 0: a row whose key another doc has too; later: whether its doc isn't the first of that key; w_text, w_pos: such
    another row of the key, its witness. kind 1: a row of the first or last key of the partition, of one doc each, to be settled
    with other partitions. kind 2: the least and the largest row of these two keys. Rows that repeat in all columns are given once.
    """
    types = [*[pa.int64()] * 3, pa.int32(), pa.int8(), pa.bool_(), pa.int64(), pa.int32()]
    schema = pa.schema(list(zip(["key", "doc", "text_key", "pos", "kind", "later", "w_text", "w_pos"], types, strict=True)))

    def out(rows: list[np.ndarray], kind: int, later: np.ndarray | None = None, witness: list[np.ndarray] | None = None) -> pa.RecordBatch:
        n = len(rows[0])
        later = np.zeros(n, bool) if later is None else later
        witness = witness or [np.zeros(n, np.int64), np.zeros(n, np.int32)]
        return pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(np.full(n, kind, np.int8)), pa.array(later), *map(pa.array, witness)], schema=schema)

    def mark(key: int, low: tuple, high: tuple) -> pa.RecordBatch:
        return out([np.full(2, key), *(np.array(x, t) for x, t in zip(zip(low, high, strict=True), (np.int64, np.int64, np.int32), strict=True))], 2)

    first_key = now = low = high = None  # now: the key that the last rows had, with its least and largest row: doc, text_key, pos
    held: list[np.ndarray] | None = None  # its rows, while they are of one doc
    last: tuple | None = None
    for batch in batches:
        rows = [batch.column(i).to_numpy() for i in range(4)]
        if not len(rows[0]):
            continue
        new = np.ones(len(rows[0]), dtype=bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in rows])
        new[0] = last is None or any(x[0] != y for x, y in zip(rows, last, strict=True))
        last = tuple(x[-1] for x in rows)
        rows = [x[new] for x in rows]
        if not len(rows[0]):
            continue
        if held is not None:
            rows = [np.concatenate([a, b]) for a, b in zip(held, rows, strict=True)]
            held = None
        key, doc = rows[0], rows[1]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        ends = np.append(starts[1:], len(key))
        low_of, high_of = ([x[at].copy() for x in rows[1:]] for at in (starts, ends - 1))
        if now == key[0]:
            for x, y in zip(low_of, low, strict=True):
                x[0] = y
        if first_key is None:
            first_key = key[0]
        group = np.repeat(np.arange(len(starts)), ends - starts)
        is_first = key == first_key
        is_last = group == len(starts) - 1
        many = low_of[0] != high_of[0]
        if key[-1] != first_key and now in (None, first_key):
            yield mark(first_key, *((tuple(x[0] for x in y) for y in (low_of, high_of)) if is_first[0] else (low, high)))
        least = doc == low_of[0][group]
        ask = is_first & least
        if ask.any():
            yield out([x[ask] for x in rows], 1)
        send = np.where(is_first, ~least, many[group])  # what follows the least doc of the first key is later for sure
        if send.any():
            of = group[send]
            yield out([x[send] for x in rows], 0, ~least[send], [np.where(least[send], h[of], w[of]) for w, h in zip(low_of[1:], high_of[1:], strict=True)])
        now, low, high = key[-1], *(tuple(x[-1] for x in y) for y in (low_of, high_of))
        if not many[-1] and now != first_key:
            held = [x[is_last] for x in rows]
    if now is not None:
        yield mark(now, low, high)
        if held is not None:
            yield out(held, 1)


def shared_rows(rows: DataFrame, name: str) -> DataFrame:
    """(key, doc, text_key, pos, later, w_text, w_pos) of the rows whose key another doc has.

    later: that doc isn't the key's first. w_text and w_pos are the place of a row of that key in another doc: following
    them leads from each row to the key's least one.

    ``rows`` are a written table. They are sorted over all partitions by range, so that a key with any number of
    rows is split. What crosses partitions is settled by the keys at their edges: at most four rows of each partition.
    """
    dealt = rows.repartitionByRange("key", "doc", "text_key", "pos").sortWithinPartitions("key", "doc", "text_key", "pos")
    seen = written(dealt.mapInArrow(_compare, f"{ROWS}, kind byte, later boolean, w_text long, w_pos int"), name)
    place = F.struct("doc", "text_key", "pos")
    marks = seen.filter("kind = 2").groupBy("key").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low.doc <> high.doc")
    edge = seen.filter("kind = 1").join(if_small(marks, EDGES), "key").withColumn("later", F.col("doc") != F.col("low.doc"))
    witness = F.when(F.col("later"), F.col("low")).otherwise(F.col("high"))
    edge = edge.select("key", "doc", "text_key", "pos", "later", witness["text_key"].alias("w_text"), witness["pos"].alias("w_pos"))
    return seen.filter("kind = 0").drop("kind").unionByName(edge)


def _passages(texts: DataFrame, places: DataFrame, columns: str) -> DataFrame:
    """``columns`` of ``places`` and passage, the words from ``start`` on, ``n`` of them; places name their text by text_key."""
    names = [c.split()[0] for c in columns.split(", ")]
    asked = places.groupBy("text_key").agg(F.collect_list(F.struct("start", "n", *[F.col(c).alias(f"_{c}") for c in names])).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words = batch.column(0)[row].cast(pa.binary()).as_py().split()
                asked = batch.column(1)[row].values
                for at in range(0, len(asked), 4096):
                    part = asked.slice(at, 4096).flatten()
                    cut = [b" ".join(words[i : i + n]) for i, n in zip(part[0].to_pylist(), part[1].to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*part[2:], pa.array(cut, pa.binary())], names=[*names, "passage"])

    return texts.join(asked, "text_key").select("text", "asked").mapInArrow(run, f"{columns}, passage binary")


def verified(shared: DataFrame, stretches: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """``shared`` (text_key, pos, later), decided by words: stretches that follow each other in their text and their witness's are
    one match, and a match's words are compared with its witness's.

    Passages with one witness are compared by their least and greatest, so a hot passage is no large group. The stretches of a
    hash that different words have are grouped by their words instead.
    """
    by_place = Window.partitionBy("text_key").orderBy("pos")
    last = lambda c: F.lag(c).over(by_place)
    same = (F.col("w_text") == last("w_text")) & (F.col("w_pos") - F.col("pos") == last("w_pos") - last("pos")) & (F.col("pos") <= last("pos") + length)
    grown = shared.withColumn("cut", F.when(same, 0).otherwise(1)).withColumn("match", F.sum("cut").over(by_place))
    matches = grown.groupBy("text_key", "match").agg(
        F.min("pos").alias("start"), (F.max("pos") - F.min("pos") + length).alias("n"), F.first("w_text").alias("w_text"), F.min("w_pos").alias("w_start")
    )
    matches = written(matches, "matches")
    theirs = matches.select(F.col("w_text").alias("text_key"), F.col("w_start").alias("start"), "n", "w_text", "w_start").distinct()
    places = matches.drop("match").unionByName(theirs).withColumn("words", F.col("n"))
    passages = _passages(texts, places, "w_text long, w_start int, words int").groupBy("w_text", "w_start", "words")
    wrong = passages.agg(F.min("passage").alias("a"), F.max("passage").alias("b")).filter("a <> b").select("w_text", "w_start", F.col("words").alias("n"))
    wrong = written(wrong, "unequal")
    if wrong.isEmpty():
        return shared.select("text_key", "pos", "later")
    bad = matches.join(wrong, ["w_text", "w_start", "n"], "left_semi").select("text_key", F.col("start").alias("from"), (F.col("start") + F.col("n") - length).alias("to"))
    bad = shared.join(bad, "text_key").filter("pos BETWEEN from AND to").select("key").distinct()
    bad = written(bad, "unequal-keys")
    places = stretches.join(bad, "key", "left_semi").select("key", "doc", "text_key", F.col("pos").alias("start"), F.lit(length).alias("n"), F.col("text_key").alias("of"), "pos")
    told = written(_passages(texts, places, "key long, doc long, of long, pos int").distinct(), "unequal-stretches")
    ends = told.groupBy("key", "passage").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low <> high")
    exact = told.join(ends, ["key", "passage"]).select(F.col("of").alias("text_key"), "pos", (F.col("doc") > F.col("low")).alias("later"))
    return shared.join(bad, "key", "left_anti").select("text_key", "pos", "later").unionByName(exact)


def repeated_passages(
    docs: DataFrame, length: int = LENGTH, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", bits: int = 64
) -> DataFrame:
    """One row for each document that shares a passage: doc_id, n_words, n_repeated, spans, later_spans.

    spans are the maximal runs of words (start, end; end exclusive) that lie in stretches of ``length`` words which
    a document of another doc_id has word for word; n_repeated is the number of these words. later_spans are the parts of
    which a document of a smaller doc_id has the stretch: cutting them keeps each passage once. Documents without such a passage
    give no row; nor do null ids or texts. Rows that repeat an id and text count once; several texts of one id
    are one document each in the result, but not compared with each other. Texts are read whole. ``bits`` of a hash choose
    which words are compared; fewer of them cost time and don't change the result.
    """
    if window + gram - 1 > length:
        raise ValueError("a window of grams must fit into the length")
    mask = -1 if bits == 64 else (1 << bits) - 1
    texts = _texts(docs, id_col, text_col)
    suffixes = written(_suffixes(texts, length, window, gram, mask), "suffixes")
    kept = shared_rows(suffixes, "suffix-matches").groupBy("text_key").agg(F.collect_list("pos").alias("places"))
    once = texts.groupBy("text_key").agg(F.min("doc_id").alias("doc"), F.first("text").alias("text"))
    near = written(once.join(kept, "text_key"), "suffix-texts")
    stretches = written(_stretches(near, length, window, mask), "stretches")
    shared = verified(shared_rows(stretches, "stretch-matches"), stretches, near.select("text_key", "text"), length)

    by_place = Window.partitionBy("text_key", "part").orderBy("pos")
    ends = shared.select("text_key", "pos", F.explode(F.when(F.col("later"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("part"))
    runs = ends.withColumn("cut", F.coalesce(F.col("pos") > F.lag("pos").over(by_place) + length, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("cut").over(by_place)).groupBy("text_key", "part", "run")
    spans = runs.agg(F.min("pos").alias("start"), (F.max("pos") + length).alias("end")).groupBy("text_key")
    listed = lambda p: F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct("start", "end"))))
    spans = spans.agg(listed(0).alias("spans"), listed(1).alias("later_spans"))

    n_words = F.size(F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "")).alias("n_words")
    owners = texts.select("doc_id", "text_key", n_words).distinct()
    copies = owners.groupBy("text_key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    known = owners.join(copies, "text_key").join(spans, "text_key", "left")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    copied = (F.col("low") != F.col("high")) & (F.col("n_words") >= length)
    known = known.select(
        "doc_id",
        "n_words",
        F.when(copied, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(copied & (F.col("doc_id") > F.col("low")), whole).otherwise(F.coalesce("later_spans", none)).alias("later_spans"),
    ).filter(F.size("spans") > 0)
    count = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return known.select("doc_id", "n_words", count.alias("n_repeated"), "spans", "later_spans")
