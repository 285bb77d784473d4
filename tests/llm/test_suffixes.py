import random

import numpy as np
import pyarrow as pa
import pytest

from tidewater.llm import suffixes


def runs(starts, length):
    out = []
    for i in sorted(starts):
        if out and i <= out[-1][1]:
            out[-1][1] = i + length
        else:
            out.append([i, i + length])
    return [tuple(x) for x in out]


def plain(rows, length):
    texts = {(i, t): t.encode().split() for i, t in rows if i is not None and t is not None}
    owners = {}
    for (i, _), words in texts.items():
        for p in range(len(words) - length + 1):
            owners.setdefault(tuple(words[p : p + length]), set()).add(i)
    out = []
    for (i, _), words in texts.items():
        many = [p for p in range(len(words) - length + 1) if len(owners[tuple(words[p : p + length])]) > 1]
        later = [p for p in many if min(owners[tuple(words[p : p + length])]) < i]
        if many:
            spans = runs(many, length)
            out.append((i, len(words), sum(e - s for s, e in spans), spans, runs(later, length)))
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, spans string, pos int")
    got = suffixes.repeated_passages(df, **options)
    assert got.columns == ["doc_id", "n_words", "n_repeated", "spans", "later_spans"]
    return sorted((r.doc_id, r.n_words, r.n_repeated, [tuple(s) for s in r.spans], [tuple(s) for s in r.later_spans]) for r in got.collect())


def corpus(length):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz")
    text = lambda n: [word() for _ in range(n)]
    shared = [text(length + d) for d in (-1, 0, 1, 5, 3 * length)]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared), text(rng.randrange(30))]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w for p in parts for w in p)))
    hot = text(2 * length)
    rows += [(100 + i, " ".join(text(rng.randrange(5)) + hot + text(rng.randrange(9)))) for i in range(60)]
    near = text(150)
    for i in range(30):
        copy = list(near)
        copy[rng.randrange(150)] = "changed"
        rows.append((200 + i, " ".join(copy)))
    rows += [(300 + i, rows[5][1]) for i in range(5)] + [(400, "short copy"), (401, "short copy"), (402, "la " * 300), (403, "la " * 120)]
    return rows + [(402, "la " * 300), (None, rows[5][1]), (500, None), (501, ""), (503, rows[61][1]), (503, rows[62][1])]


@pytest.mark.parametrize("length, window, gram", [(12, 5, 2), (50, 20, 4)])
def test_matches_brute_force(spark, length, window, gram):
    rows = corpus(length)
    assert run(spark, rows, length=length, window=window, gram=gram) == plain(rows, length)


def test_nothing_to_find(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "a " * 500), (2, "b " * 500)]) == []
    with pytest.raises(ValueError):
        run(spark, [], length=10)


def test_compare_over_batches():
    rng = np.random.default_rng(1)
    rows = sorted({(int(k), int(d), int(d), int(p)) for k, d, p in zip(rng.integers(0, 40, 600), rng.integers(0, 9, 600), rng.integers(0, 4, 600), strict=True)} | {(7, d, d, 0) for d in range(200)})
    names = ["key", "doc", "text_key", "pos"]
    types = [pa.int64()] * 3 + [pa.int32()]
    for parts, size in ((1, 1000), (3, 7), (13, 3), (40, 1)):
        cuts = sorted(rng.integers(0, len(rows), parts - 1).tolist())
        seen = []
        for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : min(i + size, b)], strict=True), types, strict=True)], names=names) for i in range(a, b, size)]
            seen += [r for x in suffixes._compare(iter(batches)) for r in x.to_pylist()]
        marks = {}
        for r in seen:
            if r["kind"] == 2:
                marks.setdefault(r["key"], set()).add(r["doc"])
        got = [(r["key"], r["doc"], r["pos"], r["later"]) for r in seen if r["kind"] == 0]
        got += [(r["key"], r["doc"], r["pos"], r["doc"] != min(marks[r["key"]])) for r in seen if r["kind"] == 1 and len(marks[r["key"]]) > 1]
        docs = {}
        for k, d, _, _ in rows:
            docs.setdefault(k, set()).add(d)
        assert sorted(got) == sorted((k, d, p, d != min(docs[k])) for k, d, _, p in rows if len(docs[k]) > 1)


@pytest.mark.parametrize("bits", [0, 9])
def test_words_decide_where_hashes_are_weak(spark, bits):
    rows = corpus(12)[:130:2]
    assert run(spark, rows, length=12, window=5, gram=2, bits=bits) == plain(rows, 12)


def test_every_witness_is_another_document(spark):
    rng = np.random.default_rng(4)
    rows = {(int(k), int(d), int(d) * 10, int(p)) for k, d, p in zip(rng.integers(0, 9, 500), rng.integers(0, 30, 500), rng.integers(0, 4, 500), strict=True)}
    got = suffixes.shared_rows(spark.createDataFrame(sorted(rows), suffixes.ROWS), "rows").collect()
    where = {(k, t, p): d for k, d, t, p in rows}
    assert got and all(where[r.key, r.w_text, r.w_pos] != r.doc for r in got)
    assert all((where[r.key, r.w_text, r.w_pos] < r.doc) == r.later for r in got)
