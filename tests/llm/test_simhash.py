import random

import xxhash
from pyspark.sql import functions as F

from tidewater.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, near):
    """values: {id: fingerprint}; the smallest id that links reach."""
    root = {k: k for k in values}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(values)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if near(values[a], values[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in ids}


def two_bits(a, b):
    return (a ^ b).bit_count() <= 2


def documents(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(120):
        text = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 300]))]
        rows.append((i, " ".join(text)))
        if len(text) > 30:
            for k in range(3):
                copy = list(text)
                copy[rng.randrange(len(copy))] = "Changed"
                rows.append((1000 + 10 * i + k, "\n".join(copy)))
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "One"), (5004, "oNE"), (5005, "É é Ab")]
    got = simhash.near_duplicates(documents(spark, rows)).toPandas().set_index("doc_id")
    fps = {i: plain_fingerprint(t) for i, t in rows}
    assert got.fingerprint.to_dict() == {i: f"{v:016x}" for i, v in fps.items()}
    assert got.component_id.to_dict() == plain_components(fps, two_bits)
    assert got.component_id.nunique() < len(rows)


def test_crowded_fingerprints_lose_no_link(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    values = {base}
    for _ in range(700):
        v = base
        for _ in range(rng.randrange(7)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    values |= {rng.getrandbits(64) for _ in range(50)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).toPandas()
    pairs = list(zip(links.a, links.b, strict=True))
    assert all(two_bits(int(a) % 2**64, int(b) % 2**64) for a, b in pairs)
    root = {v: v for v in signed}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = plain_components({v: v % 2**64 for v in signed}, two_bits)
    assert {v: find(v) for v in signed} == want
    assert len(pairs) < 80 * len(signed)


def test_odd_rows(spark):
    rows = [(None, "a b c d", "x"), (4, "a b c d", "y"), (4, "a b c d", "y"), (7, "long " * 50_000, None)]
    docs = documents(spark, rows, "doc_id long, text string, fp string").withColumn("component_id", F.lit("clash"))
    got = simhash.near_duplicates(docs).toPandas()
    assert got.columns.tolist() == ["doc_id", "fingerprint", "component_id"]
    assert len(got) == 4
    assert sorted(got.component_id) == [4, 4, 4, 7]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.toPandas().doc_id) == [4, 7]


def test_shared_ids_keep_different_texts(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10_000)}" for _ in range(40)) for _ in range(12)]
    rows = [(7, t) for t in texts] + [(7, texts[0]), (9, texts[1]), (3, texts[2])]
    kept = simhash.deduplicated(documents(spark, rows)).collect()
    assert sorted(r.text for r in kept) == sorted(texts)
    assert {r.text: r.doc_id for r in kept} == {t: 3 if t == texts[2] else 7 for t in texts}


def test_rows_without_an_id_keep_their_texts(spark):
    rng = random.Random(9)
    a, b, c, d = (" ".join(f"w{rng.randrange(10_000)}" for _ in range(40)) for _ in range(4))
    rows = [(1, a), (5, a), (5, b), (None, c), (None, a), (None, d), (None, d), (None, None)]
    kept = simhash.deduplicated(documents(spark, rows)).collect()
    assert sorted((tuple(r) for r in kept), key=str) == sorted([(1, a), (5, b), (None, c), (None, d), (None, None)], key=str)
