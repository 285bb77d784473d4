"""Scores of whole texts by a class-based bigram model with exchange clustering (Brown classes).

P(text) is the product over its words and one end mark of P(class | class before) * P(word | class). Every word that occurs in training
has a class of its own choice, by what stands before and after it in all training texts:

* the ``WORDS`` most frequent words are exchanged between classes one by one, each to where the likelihood of the class bigrams
  grows most, until a round moves none. This works on the table of their bigrams, whose size their number bounds;
* all other words begin in one class, ``REST``. A word's profile is how often each class stands before and after it; profiles are a Spark
  table with a row for each word, and each word is moved to where the likelihood grows most, given the classes. Their number grows
  with the corpus.

Transitions are counted over all training texts with the classes of all words, and smoothed with the classes' own shares. Within a class
words have the mass by their counts. Words that did not occur are one more member of ``REST``, with the weight of the words that
occurred once (Good-Turing).

Texts are read twice: for the word counts, and to be written as numbers of words. The ``HEAD`` most frequent words have a number, and what
is known of them is sent to every task; the others stand there as hashes and meet their classes in a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import written

#: Words that are exchanged one by one.
WORDS = 1024
CLASSES = 48
#: The class in which all other words begin.
REST = CLASSES - 1
#: Words that have a number: about as many, whatever the corpus.
HEAD = 100_000
#: Weight of the classes' own shares in a transition.
ALPHA = 4.0
#: Words that a task counts before it hands them on.
FLUSH = 300_000
#: In a text's numbers: the end mark, and a word without a number.
END, RARE = -2, -1

Words = list[bytes]


def words_of(text: str | None) -> Words:
    """A text's words: A-Z lowered, split at ASCII white space."""
    return (text or "").encode().lower().split()


def word_key(word: bytes) -> int:
    """What stands for a word: as Spark's xxhash64."""
    key = xxhash.xxh64_intdigest(word, 42)
    return key - (key >> 63 << 64)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a text is kept from the training: by the CRC-32 of its id's decimal digits."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all rows of ``texts`` (text); tasks add up what they read first."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(words_of(text.as_py()))
                if len(counts) > FLUSH:
                    yield out(counts)
                    counts = Counter()
        if counts:
            yield out(counts)

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_words(counts: DataFrame) -> list[tuple[bytes, int]]:
    """About the ``HEAD`` most frequent words with their counts, most frequent first.

    Which counts are high enough comes from a histogram in steps of an eighth of a power of two. Of the last step a share goes in, by the
    words' hashes. So no partition hands on more than belongs to the result.
    """
    step = F.floor(F.log2("n") * 8)
    sizes = sorted(((r["step"], r["n"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    left, inside = HEAD, F.lit(False)
    for at, n in sizes:
        share = min(1.0, left / n)
        inside = (step > at) | ((step == at) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20))))
        left -= n
        if left <= 0:
            break
    found = counts.filter(inside).select("word", "n").toArrow()
    return sorted(((w.encode(), n) for w, n in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True)), key=lambda x: (-x[1], x[0]))


def encoded(docs: DataFrame, head: Words, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, held_out, ids, keys) for each row, written: the numbers of a text's words, and the keys of those without one, in order."""
    place = {w: i for i, w in enumerate(head)}
    lists = (pa.list_(pa.int32()), pa.list_(pa.int64()))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("ids", lists[0]), ("keys", lists[1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, keys = [], []
                for text in part.column(3):
                    words = words_of(text.as_py())
                    numbers = np.fromiter(map(place.get, words, repeat(RARE)), dtype=np.int32, count=len(words))
                    ids.append(numbers)
                    keys.append([word_key(words[i]) for i in np.flatnonzero(numbers == RARE)])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(ids, lists[0]), pa.array(keys, lists[1])], schema=schema)

    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text")
    )
    return written(source.mapInArrow(run, "row long, doc_id long, held_out boolean, ids array<int>, keys array<long>"), "words")


@dataclass
class Sequence:
    """The texts of a batch one after the other, with an end mark before, between and behind them."""

    numbers: np.ndarray
    starts: np.ndarray  # of a text's words among all words
    ends: np.ndarray
    keys: np.ndarray  # of the words without a number

    @classmethod
    def of(cls, ids: pa.ListArray, keys: pa.ListArray) -> Sequence:
        flat, lengths = ids.flatten().to_numpy(), pc.list_value_length(ids).to_numpy()
        ends = np.cumsum(lengths)
        return cls(np.insert(flat, np.append(ends - lengths, len(flat)), END), ends - lengths, ends, keys.flatten().to_numpy())

    def by_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over each text of values of its words and its own end mark; ``values`` are of the marks and words behind the first mark."""
        sums, k = np.concatenate([[0.0], np.cumsum(values)]), np.arange(len(self.starts))
        return sums[self.ends + k + 1] - sums[self.starts + k]


def unit_bigrams(texts: DataFrame, units: int, head: int) -> np.ndarray:
    """How often a unit follows a unit, as (units + 2, units + 2): 0 the end mark, then the single words, then all others."""
    n = units + 2
    unit_of = np.concatenate([np.minimum(np.arange(head), units) + 1, [0, n - 1]])
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, dtype=np.int64)
        for batch in batches:
            row = unit_of[Sequence.of(*batch.columns).numbers]
            total += np.bincount(row[:-1] * n + row[1:], minlength=n * n)
            total[0] -= batch.num_rows == 0
        pairs = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(total[pairs])], schema=schema)

    table = texts.select("ids", "keys").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n * n, dtype=np.int64)
    out[table.column("pair").to_numpy()] = table.column("n").to_numpy()
    return out.reshape(n, n)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int = CLASSES, rest: bool = False) -> np.ndarray:
    """The class of each unit. Class 0 is the end mark's alone; with ``rest`` the last unit stays in the last class, alone too.

    The most frequent units begin with a class each; the others are put, by frequency, where the likelihood gains most, and
    then units are exchanged until a round moves none. As every move gains, and more than rounding can, this ends.
    """
    n = len(pairs)
    by_count = np.argsort(-(pairs.sum(0) + pairs.sum(1))[1 : n - rest], kind="stable") + 1
    nowhere, top = classes, classes - rest  # words go to the classes 1 to top - 1
    of = np.full(n, nowhere, dtype=np.int64)
    of[0] = 0
    of[n - 1 :] = of[n - 1 :] if not rest else classes - 1
    of[by_count[: top - 1]] = np.arange(1, min(len(by_count) + 1, top))
    pairs = pairs.astype(np.float64)
    one = np.eye(classes + 1)[of]
    table = (one.T @ pairs @ one)[:classes, :classes]
    least, moved = 1e-6 + 1e-10 * float(_xlogx(table.sum())), 1
    while moved:
        moved = 0
        for u in by_count:
            out, into, self_n = np.bincount(of, pairs[u], classes + 1), np.bincount(of, pairs[:, u], classes + 1), pairs[u, u]
            a = of[u]
            out[a] -= self_n
            into[a] -= self_n
            out, into = out[:classes], into[:classes]
            if a != nowhere:
                table[a] -= out
                table[:, a] -= into
                table[a, a] -= self_n
            # Wherever the unit goes, what stands before it keeps that in its row, and what stands after it in its column.
            before, after = table.sum(1) + into, table.sum(0) + out
            old = _xlogx(table)
            rise_row, rise_col = _xlogx(table + out) - old, _xlogx(table.T + into) - old.T
            own = np.diag(table)
            gain = rise_row.sum(1) - np.diag(rise_row) + rise_col.sum(1) - np.diag(rise_col) + _xlogx(own + out + into + self_n) - _xlogx(own)
            gain -= _xlogx(before + out.sum() + self_n) - _xlogx(before) + _xlogx(after + into.sum() + self_n) - _xlogx(after)
            b = int(gain[1:top].argmax()) + 1
            if a != nowhere and gain[b] <= gain[a] + least:
                b = a
            table[b] += out
            table[:, b] += into
            table[b, b] += self_n
            moved += a != b
            of[u] = b
    return of


def profiles(texts: DataFrame, keys: np.ndarray, units: int, class_of: np.ndarray) -> DataFrame:
    """(word_key, head, places, ns) for each word but the units: how often each class stands before it (place) and after it (CLASSES + place).

    ``class_of`` has the classes by number, ``keys`` the keys. Tasks add up what they read, so that a word has few rows from each.
    """
    lookup = np.concatenate([class_of, [0, REST]])
    schema = pa.schema([("word_key", pa.int64()), ("head", pa.bool_()), ("place", pa.int32()), ("n", pa.int64())])

    def out(key: np.ndarray, head: bool, place: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), head)), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int64))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = Sequence.of(*batch.columns)
            classes = lookup[text.numbers]
            known, rare = np.flatnonzero(text.numbers >= units), np.flatnonzero(text.numbers == RARE)
            width = 2 * CLASSES
            codes = text.numbers[known].astype(np.int64) * width
            codes, n = np.unique(np.concatenate([codes + classes[known - 1], codes + CLASSES + classes[known + 1]]), return_counts=True)
            yield out(keys[codes // width], True, codes % width, n)
            yield out(np.tile(text.keys, 2), False, np.concatenate([classes[rare - 1], CLASSES + classes[rare + 1]]), np.ones(2 * len(rare)))

    rows = texts.select("ids", "keys").mapInArrow(run, "word_key long, head boolean, place int, n long").repartition("word_key")
    by_place = rows.groupBy("word_key", "place").agg(F.max("head").alias("head"), F.sum("n").alias("n"))
    return by_place.groupBy("word_key").agg(F.max("head").alias("head"), F.collect_list("place").alias("places"), F.collect_list("n").alias("ns"))


def best_classes(owner: np.ndarray, place: np.ndarray, n: np.ndarray, words: int, table: np.ndarray) -> np.ndarray:
    """The class of each word, from its profile's entries (owner: the word's place in the result), by the gain of moving it out of ``REST``."""
    table = table.astype(np.float64)
    after, size = place >= CLASSES, table.shape[0]
    cells = np.where(after[:, None], table[:, place % CLASSES].T, table[place % CLASSES])  # entry by class
    count = n.astype(np.float64)[:, None]
    gain = _xlogx(cells + count) - _xlogx(cells)
    gain[:, REST] = _xlogx(cells[:, REST]) - _xlogx(cells[:, REST] - count[:, 0])
    found = np.zeros((words, size))
    np.add.at(found, owner, gain)
    sides = []
    for side, totals in ((~after, table.sum(0)), (after, table.sum(1))):
        beside = np.zeros((words, size))
        np.add.at(beside, (owner[side], place[side] % CLASSES), n[side])
        mass = beside.sum(1)[:, None]
        loss = _xlogx(totals + mass) - _xlogx(totals)
        loss[:, REST] = _xlogx(totals[REST]) - _xlogx(totals[REST] - mass[:, 0])
        found -= loss
        sides.append(beside)
    # A class beside a word of its own changes one cell from both sides.
    into, out = sides
    own = np.broadcast_to(np.diag(table), into.shape).copy()
    own[:, REST] -= into[:, REST] + out[:, REST]
    joint = _xlogx(own + into + out) - _xlogx(own)
    alone = _xlogx(own + into) + _xlogx(own + out) - 2 * _xlogx(own)
    whole = table[REST, REST]
    alone[:, REST] = 2 * _xlogx(whole) - _xlogx(whole - into[:, REST]) - _xlogx(whole - out[:, REST])
    return (found + joint - alone)[:, 1:].argmax(axis=1) + 1


def assigned(profile: DataFrame, table: np.ndarray) -> DataFrame:
    """(word_key, head, class, n) of all words with a profile, written; n is the word's count, as each of its places has something before it."""
    schema = pa.schema([("word_key", pa.int64()), ("head", pa.bool_()), ("class", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                owner = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(2)).to_numpy())
                place, n = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
                of = best_classes(owner, place, n, part.num_rows, table).astype(np.int32)
                count = np.bincount(owner, np.where(place < CLASSES, n, 0), part.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(of), pa.array(count)], schema=schema)

    return written(profile.mapInArrow(run, "word_key long, head boolean, class int, n long"), "word-classes")


@dataclass
class Classes:
    """The classes of all words: by number of those that have one, and as a table (word_key, head, class, n) of all but the units."""

    head: Words
    counts: np.ndarray
    of_head: np.ndarray
    table: DataFrame


def cluster(texts: DataFrame, head: list[tuple[bytes, int]]) -> Classes:
    """Classes of the words of encoded training texts."""
    words = [w for w, _ in head]
    units, keys = min(WORDS, len(words)), np.array([word_key(w) for w in words], dtype=np.int64)
    pairs = unit_bigrams(texts, units, len(words))
    of_unit = exchange(pairs, rest=True)
    one = np.eye(CLASSES)[of_unit]
    of_head = np.full(len(words), REST, dtype=np.int64)
    of_head[:units] = of_unit[1 : units + 1]
    table = assigned(profiles(texts, keys, units, of_head), one.T @ pairs @ one)
    place = {k: i for i, k in enumerate(keys.tolist())}
    known = table.filter("head").select("word_key", "class").toArrow()
    for key, c in zip(known.column(0).to_pylist(), known.column(1).to_pylist(), strict=True):
        of_head[place[key]] = c
    return Classes(words, np.array([n for _, n in head], dtype=np.int64), of_head, table)


def rare_tokens(texts: DataFrame, classes: Classes) -> DataFrame:
    """(row, held_out, class, n, before, after), written, for each place of a word without a number.

    n is its training count; ``after`` is -1 where another such word follows, which has this one's class for ``before``.
    """
    lookup = np.concatenate([classes.of_head, [0, -1]]).astype(np.int32)
    names = "row long, held_out boolean, pos long, word_key long, before int, after int"
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    schema = pa.schema(list(zip([x.split()[0] for x in names.split(", ")], types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = Sequence.of(batch.column(2), batch.column(3))
            rare, of = np.flatnonzero(text.numbers == RARE), lookup[text.numbers]
            owner = np.searchsorted(text.ends + np.arange(len(text.ends)) + 1, rare)  # each text's end mark is behind it
            own = pa.array(owner)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *map(pa.array, (rare, text.keys, of[rare - 1], of[rare + 1]))], schema=schema)

    tokens = texts.select("row", "held_out", "ids", "keys").mapInArrow(run, names)
    known = tokens.join(classes.table.select("word_key", "class", "n"), "word_key", "left").fillna({"class": REST, "n": 0})
    last = F.lag("class").over(Window.partitionBy("row").orderBy("pos"))
    return written(known.select("row", "held_out", "class", "n", F.when(F.col("before") < 0, last).otherwise(F.col("before")).alias("before"), "after"), "rare-words")


def transitions(texts: DataFrame, tokens: DataFrame, of_head: np.ndarray) -> np.ndarray:
    """How often a class follows a class, over encoded texts and their rare tokens."""
    lookup = np.concatenate([of_head, [0, -1]])
    schema = pa.schema([("pair", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, dtype=np.int64)
        for batch in batches:
            row = lookup[Sequence.of(*batch.columns).numbers]
            both = (row[:-1] >= 0) & (row[1:] >= 0)
            total += np.bincount(row[:-1][both] * CLASSES + row[1:][both], minlength=len(total))
            total[0] -= batch.num_rows == 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], schema=schema)

    pair = lambda a, b: (F.col(a) * CLASSES + F.col(b)).alias("pair")
    rare = tokens.select(pair("before", "class")).unionByName(tokens.filter("after >= 0").select(pair("class", "after"))).groupBy("pair").agg(F.count("*").alias("n"))
    both = texts.select("ids", "keys").mapInArrow(run, "pair int, n long").unionByName(rare).groupBy("pair").agg(F.sum("n").alias("n"))
    out = np.zeros(CLASSES * CLASSES)
    for r in both.collect():
        out[r["pair"]] = r["n"]
    return out.reshape(CLASSES, CLASSES)


@dataclass
class Model:
    """n: all training tokens, types: distinct ones, ends: training texts."""

    classes: Classes
    transition: np.ndarray  # log10, class before by class
    unseen: np.ndarray  # share of a class for words that did not occur
    mass: np.ndarray  # tokens of a class
    n: int
    types: int
    ends: int

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1.0) / (self.n + self.types + 1.0))

    def emission(self, count: np.ndarray, of: np.ndarray) -> np.ndarray:
        """log10 P(word | class) by the word's count and class."""
        with np.errstate(divide="ignore"):
            return np.where(count > 0, np.log10(np.maximum(count, 1) * (1 - self.unseen[of]) / np.maximum(self.mass[of], 1)), np.log10(self.unseen[of]))


def fit(texts: DataFrame, tokens: DataFrame, counts: DataFrame, classes: Classes) -> Model:
    """The model of encoded training texts, their rare tokens, the words' counts and classes."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("types"), F.count_if(F.col("n") == 1).alias("once")).first()
    ends = texts.count()
    table = transitions(texts, tokens, classes.of_head)
    share = (table.sum(0) + 1) / (table.sum() + CLASSES)
    transition = np.log10((table + ALPHA * share) / (table.sum(1, keepdims=True) + ALPHA))
    mass, unseen = table.sum(0), np.zeros(CLASSES)
    unseen[REST] = (total["once"] + 0.5) / (total["once"] + 0.5 + mass[REST]) if mass[REST] else 1.0
    return Model(classes, transition, unseen, mass, int(total["n"]) + ends, int(total["types"]) + (ends > 0), ends)


def _scored(texts: DataFrame, tokens: DataFrame, model: Model) -> DataFrame:
    names = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    schema = pa.schema(list(zip([x.split()[0] for x in names.split(", ")], types, strict=True)))
    counts, of_head = model.classes.counts, model.classes.of_head
    class_of = np.concatenate([of_head, [0, -1]])
    base_of = np.concatenate([model.base(counts), [float(model.base(np.array([model.ends]))[0]), 0.0]])
    emission_of = np.concatenate([model.emission(counts, of_head), [0.0, 0.0]])
    transition, ends_known = model.transition, int(model.ends > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = Sequence.of(batch.column(3), batch.column(4))
            numbers = text.numbers[1:]
            of = class_of[text.numbers]
            both = (of[:-1] >= 0) & (of[1:] >= 0)
            score = np.where(both, transition[of[:-1], of[1:]], 0.0) + emission_of[numbers]
            known = np.rint(text.by_text(numbers >= 0)).astype(np.int64) + ends_known
            columns = [text.ends - text.starts + 1, known, text.by_text(base_of[numbers]), text.by_text(score)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c, t) for c, t in zip(columns, types[3:], strict=True)]], schema=schema)

    whole = texts.select("row", "doc_id", "held_out", "ids", "keys").mapInArrow(run, names)
    pick = lambda values, at: F.get(F.lit([float(v) for v in values]), at)
    n, of = F.col("n"), F.col("class")
    follows = lambda a, b: pick(model.transition.ravel(), F.col(a) * CLASSES + F.col(b))
    word = F.when(n > 0, F.log10(n * (1 - pick(model.unseen, of)) / pick(np.maximum(model.mass, 1), of))).otherwise(F.log10(pick(model.unseen, of)))
    step = word + follows("before", "class") + F.when(F.col("after") >= 0, follows("class", "after")).otherwise(0.0)
    rare = tokens.groupBy("row").agg(F.count_if(n > 0).alias("more_known"), F.sum(F.log10((n + 1) / F.lit(float(model.n + model.types + 1)))).alias("more_base"), F.sum(step).alias("more_score"))
    more = lambda name, x: (F.col(name) + F.coalesce(x, F.lit(0))).alias(name)
    return whole.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", more("n_known", "more_known"), F.lit(model.n).cast("long").alias("train_tokens"), more("base_score", "more_base"), more("score", "more_score")
    )


def train(docs: DataFrame, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on all rows of ``docs``; ``counts`` are their words' counts, written."""
    head = head_words(counts)
    texts = encoded(docs, [w for w, _ in head], id_col, text_col)
    classes = cluster(texts, head)
    return fit(texts, rare_tokens(texts, classes), counts, classes)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    texts = encoded(docs, model.classes.head, id_col, text_col)
    return _scored(texts, rare_tokens(texts, model.classes), model)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the texts that aren't held out and score all, one row per row of ``docs``.

    Columns: doc_id, held_out, n_tokens (words and one end mark), n_known (tokens that occurred in training), train_tokens, base_score
    (a unigram model with one added to each count), score (the class model), both log10 probabilities of the whole text. A null text
    is empty: one end mark. Null ids count as training texts. Repeated rows keep their rows and count as often.
    Other columns are not read; an empty table gives an empty result.
    """
    training = docs.filter(~held_out(id_col)).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = written(word_counts(training), "word-counts")
    head = head_words(counts)
    texts = encoded(docs, [w for w, _ in head], id_col, text_col)
    learned = texts.filter("NOT held_out")
    classes = cluster(learned, head)
    tokens = rare_tokens(texts, classes)
    return _scored(texts, tokens, fit(learned, tokens.filter("NOT held_out"), counts, classes))
