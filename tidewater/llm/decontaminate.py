"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Texts and benchmark items are cut into words (runs of letters and digits, in lower case). At every position
fixed masks pick five words and ignore those between; the hash of the picked words is a seed. Seeds of the training
texts are joined with those of the items. A hit fixes a diagonal: where the item would lie in the text. On it the words are
compared place by place, and the item counts as leaked if some window of ``SPAN`` of its words (the whole item, if it is
shorter) has at least 0.8 of them in place. A window slides along a diagonal as the bits of one number.

The masks follow the item's length: however the substitutions lie that ``SIMILARITY`` allows, some mask picks none of them. A window
of 13 words with two substituted ones still holds a seed of ``LONG``; items of 5 to 12 words have masks of four words in
``SHORT``. Items of fewer than five words allow no substitution, and their mask is the whole item. Texts are cut by the masks of the
lengths that occur.

What is joined is small rows: a text's key, a place and a seed. Of the hits only distinct diagonals are kept, and they are
what brings the words of a text and an item together, once for each pair of a distinct text and an item. The seeds of the items
are broadcast after they have been counted, as are the texts that they hit; beyond ``BROADCAST`` rows either join is a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import if_small, written

#: Places of the words that a mask picks, for windows of ``SPAN`` words.
LONG = (0, 1, 3, 6, 7)
#: The masks of shorter items by their number of words.
_A, _B, _C, _D = (0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4)
SHORT = {1: ((0,),), 2: ((0, 1),), 3: ((0, 1, 2),), 4: (_A,), 5: (_A, _B, _C, _D), 6: (_A, _C), 7: (_C,), 8: (_A,), 9: (_A,), 10: (_A, _B), 11: (_B,), 12: (_A,)}
SPAN = 13
SIMILARITY = 0.8
#: Rows of four numbers that may be sent to every task.
BROADCAST = 500_000


def word_hashes(text: Column) -> Column:
    """The hashes of a text's words, in order."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(words: str, i: int, mask: tuple[int, ...]) -> Column:
    """The seeds of one mask at all places where it fits."""
    at_all = F.sequence(F.lit(0), F.size(words) - mask[-1] - 1)
    pick = F.transform(at_all, lambda at: F.xxhash64(F.lit(i), *[F.get(F.col(words), at + k) for k in mask]))
    return F.when(F.size(words) > mask[-1], pick).otherwise(F.array().cast("array<bigint>"))


def masks_of(n_words: int) -> tuple[tuple[int, ...], ...]:
    """The masks of an item of that many words."""
    return (LONG,) if n_words >= SPAN else SHORT.get(n_words, ())


def seeds(df: DataFrame, words: Column, key: str, by_length: dict[int, tuple], of_items: bool = False) -> DataFrame:
    """(key, mask, pos, seed): a row for each mask and place at which it fits; ``words`` are the hashes of the words.

    ``by_length`` has the masks of each item length that occurs (``SPAN`` for longer ones). Items have the seeds of their length's masks, texts those of all.
    """
    masks = sorted({m for some in by_length.values() for m in some})
    rows = df.select(key, words.alias("_words"))
    found = []
    for i, mask in enumerate(masks):
        own = F.least(F.size("_words"), F.lit(SPAN)).isin([n for n, some in by_length.items() if mask in some])
        found.append(F.when(own, _seeds("_words", i, mask)).otherwise(F.array().cast("array<bigint>")) if of_items else _seeds("_words", i, mask))
    rows = rows.select(key, F.posexplode(F.array(*found).cast("array<array<bigint>>")).alias("mask", "_all"))
    return rows.select(key, "mask", F.posexplode("_all").alias("pos", "seed"))


def _on_diagonal(words: str, item: str, at: Column, span: int) -> Column:
    """(n_found, best) where the item lies ``at`` words behind the text's beginning: its words in place, and the most of them in a window."""
    first = F.greatest(F.lit(0), -at)
    n = F.least(F.size(item), F.size(words) - at) - first
    hits = F.zip_with(F.slice(F.col(item), first + 1, n), F.slice(F.col(words), first + at + 1, n), lambda x, y: x == y)
    start = F.struct(F.lit(0).cast("long").alias("window"), F.lit(0).alias("n_found"), F.lit(0).alias("best"))

    def step(state: Column, hit: Column) -> Column:
        window = F.shiftleft(state["window"], 1).bitwiseOR(F.when(hit, 1).otherwise(0).cast("long")).bitwiseAND(F.lit((1 << span) - 1).cast("long"))
        found = state["n_found"] + F.when(hit, 1).otherwise(0)
        return F.struct(window.alias("window"), found.alias("n_found"), F.greatest(state["best"], F.bit_count(window)).alias("best"))

    return F.aggregate(hits, start, step)


def text_key(text: Column) -> Column:
    """What stands for a whole text."""
    return F.xxhash64(text, F.length(text))


def _leaked(
    docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id_col: str, item_text_col: str, span: int, similarity: float, broadcast: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts (doc_id, text, text_key), the items (item_id, item_key, item) and what leaked (text_key, item_key, top)."""
    if not 0 < span < 64:
        raise ValueError("a window has 1 to 63 words")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    texts = texts.withColumn("text_key", text_key(F.col("text")))
    tests = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    tests = tests.distinct().select("item_id", text_key(F.col("text")).alias("item_key"), word_hashes(F.col("text")).alias("item"))
    tests = written(tests, "items")
    lengths = [r[0] for r in tests.select(F.least(F.size("item"), F.lit(SPAN))).distinct().collect()]
    by_length = {n: masks_of(n) for n in lengths}
    wanted = written(seeds(tests, F.col("item"), "item_key", by_length, of_items=True).withColumnRenamed("pos", "item_pos").distinct(), "item-seeds")
    hits = seeds(texts, word_hashes(F.col("text")), "text_key", by_length).join(if_small(wanted, broadcast), ["seed", "mask"])
    places = written(hits.select("text_key", "item_key", (F.col("pos") - F.col("item_pos")).alias("at")).distinct(), "diagonals")

    hit_keys = if_small(places.select("text_key").distinct(), broadcast)
    words = texts.join(hit_keys, "text_key", "left_semi").dropDuplicates(["text_key"]).select("text_key", word_hashes(F.col("text")).alias("words"))
    by_item = tests.select("item_key", "item").dropDuplicates(["item_key"])
    cases = places.groupBy("text_key", "item_key").agg(F.collect_list("at").alias("ats")).join(by_item, "item_key").join(words, "text_key")
    size = F.size("item")
    scored = F.transform("ats", lambda at: _on_diagonal("words", "item", at, span))
    tops = F.transform(scored, lambda x: F.struct(x["n_found"].alias("n_found"), (x["best"] / F.least(size, F.lit(span))).alias("similarity"), size.alias("n_words")))
    tops = cases.select("text_key", "item_key", F.array_max(F.filter(tops, lambda x: x["similarity"] >= similarity)).alias("top"))
    leaked = written(tops.filter("top IS NOT NULL"), "leaks")
    return texts, tests, leaked


def leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    span: int = SPAN, similarity: float = SIMILARITY, broadcast: int = BROADCAST,
) -> DataFrame:
    """One row for each document and item that leaked into it: doc_id, item_id, n_words, n_found, similarity.

    n_words are the item's, n_found those in place on the best diagonal, similarity the best window's share. Documents without a leak
    give no row. Null texts hold no words. Rows that repeat an id are taken together, null ids too. Other
    columns are not read; empty tables give an empty result. Texts are read whole.
    """
    texts, tests, leaked = _leaked(docs, items, id_col, text_col, item_id_col, item_text_col, span, similarity, broadcast)
    rows = texts.select("doc_id", "text_key").join(leaked, "text_key").join(tests.select("item_id", "item_key"), "item_key")
    rows = rows.groupBy("doc_id", "item_id").agg(F.max("top").alias("top"))
    return rows.select("doc_id", "item_id", "top.n_words", "top.n_found", "top.similarity")


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` into whose text no item leaked, whatever their ids; columns stay as they are.

    Null texts hold no item and stay, as do rows that repeat; without items every row stays, and an empty table stays empty.
    """
    *_, leaked = _leaked(docs, items, "doc_id", "text", "item_id", "text", SPAN, SIMILARITY, BROADCAST)
    bad = if_small(leaked.select(F.col("text_key").alias("leaked_key")).distinct(), BROADCAST)
    return docs.join(bad, text_key(docs["text"].cast("string")) == bad["leaked_key"], "left_anti")
