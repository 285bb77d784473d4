import itertools
import math
import random
import re
import time

import pytest

from tidewater.llm import decontaminate


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def plain(docs, items, span=13):
    best = {}
    for i, text in docs:
        words = tokens(text)
        for j, test in items:
            item = tokens(test)
            if len(item) < 5 or len(words) < 5:
                continue
            size = min(span, len(item))
            for at in range(-len(item) + 1, len(words)):
                hits = [0 <= k + at < len(words) and words[k + at] == w for k, w in enumerate(item)]
                top = max(sum(hits[s : s + size]) for s in range(len(item) - size + 1))
                if top >= math.ceil(0.8 * size - 1e-9):
                    best[i, j] = max(best.get((i, j), (0, 0, 0)), (sum(hits), top / size, len(item)))
    return {k: (n, found, pytest.approx(s)) for k, (found, s, n) in best.items()}


def corpus():
    rng = random.Random(6)
    vocabulary = [a + b for a in "bcdfgh" for b in "aeiouy"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(j, " ".join(text(rng.randrange(13, 40)))) for j in range(30)]
    docs = []
    for i in range(200):
        words = text(rng.randrange(4, 60))
        if i % 2:
            item = items[rng.randrange(30)][1].split()
            a = rng.randrange(max(1, len(item) - 13))
            part = item[a : a + rng.randrange(8, 30)]
            for _ in range(rng.randrange(4)):
                part[rng.randrange(len(part))] = "zz"
            words[5:5] = part
        docs.append((i, "  ".join(words).title() if i % 3 else ", ".join(words)))
    return docs, items


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST, 0])
def test_matches_brute_force(spark, broadcast):
    docs, items = corpus()
    items.append((50, "only six words are in here"))
    docs += [(900, "Well: only SIX words are in here!"), (901, "only six words are not here")]
    d = spark.createDataFrame([(i, t, "clash", 0) for i, t in docs], "doc_id long, text string, item_id string, words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(d, b, broadcast=broadcast)
    assert got.columns == ["doc_id", "item_id", "n_words", "n_found", "similarity"]
    got = {(r.doc_id, r.item_id): (r.n_words, r.n_found, r.similarity) for r in got.collect()}
    want = plain(docs, items)
    assert (901, 50) in want
    assert got == want
    assert len(got) > 50


def test_odd_rows(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, None), (2, ""), (None, item), (3, item), (3, item), (4, "x " * 50_000 + item), (5, "short")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (None, ""), (3, "one two")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()), key=str)
    assert got == [(3, 1), (4, 1), (None, 1)]
    assert sorted(r.doc_id for r in decontaminate.decontaminated(docs, items).collect()) == [1, 2, 5]
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.leaks(docs.limit(0), items).count() == 0
    plan = decontaminate.leaks(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def allowed(n):
    """Every way to substitute as many of n words as the threshold allows."""
    return itertools.combinations(range(n), n - math.ceil(0.8 * n - 1e-9))


@pytest.mark.parametrize("n", range(5, 14))
def test_a_mask_avoids_the_substitutions(n):
    for gone in allowed(n):
        assert any(not {a + k for k in m} & {*gone} for m in decontaminate.masks_of(n) for a in range(n - m[-1])), gone


def test_short_items_with_substitutions(spark):
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(5, 14)]
    docs = []
    for n, text in items:
        for gone in allowed(n):
            words = ["zz" if k in gone else w for k, w in enumerate(text.split())]
            docs.append((len(docs), " ".join(["before", *words, "after"]), n))
        one_more = [*text.split()[:1], *["zz"] * 3, *text.split()[4:]]
        docs.append((len(docs), " ".join(one_more), None))
    docs.append((len(docs), " ".join(items[0][1].split()[1:]), 5))  # at the edge of a text
    d = spark.createDataFrame([r[:2] for r in docs], "doc_id long, text string")
    got = decontaminate.leaks(d, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(i, n) for i, _, n in docs if n}


def test_a_leak_takes_its_text_alone(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(3, item), (3, "clean"), (None, item), (None, "clean too"), (4, "x " + item), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {(r.doc_id, r.text) for r in decontaminate.decontaminated(docs, items).collect()}
    assert got == {(3, "clean"), (None, "clean too"), (4, None)}


def test_items_under_five_words_must_be_there_whole(spark):
    items = [(1, "one"), (2, "two words"), (3, "three words here"), (4, "and these are four"), (5, "!!")]
    docs = [(1, "just ONE"), (2, "two words"), (3, "two other words"), (4, "well: three words here, and these are four"), (5, "these are four"), (6, ""), (7, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 2), (4, 3), (4, 4)}
    assert all(r.similarity == 1 and r.n_found == r.n_words for r in got)
    assert sorted(r.doc_id for r in decontaminate.decontaminated(d, b).collect()) == [3, 5, 6, 7]


def test_repeated_words_stay_fast(spark):
    item = "la " * 1000
    d = spark.createDataFrame([(1, "la " * 1000), (2, "la " * 9 + "ti " * 3000), (3, "la " * 12)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.leaks(d, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: (1, 1000, 1000, 1.0), 3: (1, 1000, 12, pytest.approx(12 / 13))}
    assert time.time() - began < 40
