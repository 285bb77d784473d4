import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import brown
from tidewater.llm.common import written

DOCS = "/root/testdata/sf0.01/documents.parquet"


def plain_base(rows):
    split = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in split(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        words = split(t)
        out.append((i, held(i), len(words), sum(counts[w] > 0 for w in words), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)))
    return out, counts


def compare(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got = sorted(got, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in sorted(want, key=key)]
    assert np.allclose([r[5] for r in got], [r[5] for r in sorted(want, key=key)])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(DOCS)


def test_base_and_held_out_score(docs, monkeypatch):
    monkeypatch.setattr(brown, "HEAD", 3000)
    got = brown.report(docs).collect()
    want, _ = plain_base([(r.doc_id, r.text) for r in docs.collect()])
    compare([tuple(r) for r in got], want)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in got)


def test_model_is_a_distribution(docs, monkeypatch):
    monkeypatch.setattr(brown, "HEAD", 500)
    training = docs.filter(~brown.held_out()).limit(300)
    training = training.select("doc_id", "text")
    counts = written(brown.word_counts(training), "counts")
    model = brown.train(training, counts)
    assert np.allclose((10**model.transition).sum(1), 1)
    by_class, class_of = Counter(), classes_of(model)
    vocabulary = {r.word.encode(): r.n for r in counts.collect()}
    assert all(w in class_of for w in vocabulary)
    for w, n in vocabulary.items():
        c = class_of[w]
        by_class[c] += 10 ** model.emission(np.array([n]), np.array([c]))[0]
    for c, mass in by_class.items():
        assert mass + model.unseen[c] == pytest.approx(1)
    for r in brown.scored(training.limit(40), model).join(training, "doc_id").collect():
        score, before = 0.0, 0
        for w in brown.words_of(r.text):
            c = class_of[w]
            score += model.transition[before, c] + model.emission(np.array([vocabulary.get(w, 0)]), np.array([c]))[0]
            before = c
        assert r.score == pytest.approx(score + model.transition[before, 0])


class ByKey(dict):
    """Classes by word: those with a number by themselves, the others by their key."""

    def __missing__(self, word):
        return self[("key", brown.word_key(word))]

    def __contains__(self, word):
        return dict.__contains__(self, word) or dict.__contains__(self, ("key", brown.word_key(word)))


def classes_of(model):
    known = model.classes
    out = ByKey({("key", r.word_key): r["class"] for r in known.table.collect()})
    out.update(zip(known.head, known.of_head.tolist(), strict=True))
    return out


def test_every_word_is_where_the_likelihood_is_highest(docs, monkeypatch):
    """Move each of some words from REST to every class and count the likelihood of the class bigrams anew."""
    monkeypatch.setattr(brown, "HEAD", 400)
    monkeypatch.setattr(brown, "WORDS", 100)
    training = written(docs.filter(~brown.held_out()).select("doc_id", "text").limit(120), "training")
    counts = written(brown.word_counts(training), "counts")
    head = brown.head_words(counts)
    assert 350 <= len(head) <= 440  # about as many: the share of the last step goes by hashes
    texts = [brown.words_of(r.text) for r in training.collect()]
    classes = brown.cluster(brown.encoded(training, [w for w, _ in head]), head)
    units = dict(zip(classes.head[:100], classes.of_head[:100].tolist(), strict=True))

    def likelihood(extra):
        table = np.zeros((brown.CLASSES, brown.CLASSES))
        for words in texts:
            row = [0, *[extra.get(w, units.get(w, brown.REST)) for w in words], 0]
            np.add.at(table, (row[:-1], row[1:]), 1)
        return (brown._xlogx(table).sum() - brown._xlogx(table.sum(0)).sum() - brown._xlogx(table.sum(1)).sum()).item()

    follows = Counter((a, b) for words in texts for a, b in zip(words, words[1:], strict=False))
    chosen = [w for w, _ in head[100::40]] + [w for w in sorted({w for words in texts for w in words} - {w for w, _ in head})[::900]]
    class_of, checked = classes_of(type("M", (), {"classes": classes})), 0
    for w in chosen:
        if follows[w, w]:  # profiles count a word beside itself as REST
            continue
        gains = [likelihood({w: c}) for c in range(1, brown.CLASSES)]
        assert gains[class_of[w] - 1] == pytest.approx(max(gains), abs=1e-6)
        checked += 1
    assert checked > 8


def test_exchange_finds_classes():
    rng = np.random.default_rng(2)
    n, pairs = 41, np.zeros((41, 41), dtype=np.int64)
    now = 1
    for _ in range(20000):  # odd units follow even ones
        step = rng.integers(0, 20) * 2 + 1 + (now % 2)
        pairs[now, step] += 1
        now = step
    of = brown.exchange(pairs, classes=7)
    assert of[0] == 0 and not {0, 7} & {*of[1:]}
    assert not {*of[1::2]} & {*of[2::2]}  # no class mixes the two kinds


@pytest.mark.parametrize("rest", [False, True])
def test_exchange_ends_where_no_move_gains(rest):
    rng = np.random.default_rng(5)
    for _ in range(5):
        n, k = 30, 6
        pairs = rng.poisson(rng.gamma(0.3, 4, (n, n)))
        of = brown.exchange(pairs, classes=k, rest=rest)

        def likelihood(of, pairs=pairs):
            one = np.eye(6)[of]
            table = one.T @ pairs @ one
            return (brown._xlogx(table).sum() - brown._xlogx(table.sum(0)).sum() - brown._xlogx(table.sum(1)).sum()).item()

        top = likelihood(of)
        for u in range(1, n - rest):
            for c in range(1, k - rest):
                moved = of.copy()
                moved[u] = c
                assert likelihood(moved) <= top + 1e-4
        assert of[0] == 0 and (of[-1] == k - 1) >= rest


def test_odd_rows(spark):
    rows = [(i, "the cat sat on the mat " * (i % 4)) for i in range(30)] + [(None, "Cat \t nap"), (3, None), (3, None), (99, "É x"), (100, "dog " * 30_000)]
    df = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in rows], "doc_id long, text string, word string, score double")
    got = brown.report(df)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    compare([tuple(r) for r in got.collect()], plain_base(rows)[0])
    assert brown.report(df.limit(0)).count() == 0
    only_held = df.filter("doc_id is not null").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    assert all(r.base_score == 0 and r.train_tokens == 0 for r in brown.report(only_held).collect())
