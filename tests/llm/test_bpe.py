import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from tidewater.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def library_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def oracle():
    return library_encoding()


def texts():
    rng = random.Random(1)
    every = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    out = ["", " ", "  \n\n x", "it's we'll I'M", "a" * 3000, "ab" * 2000, " " * 500 + "x", "été ñandú 漢字 😀😀", "\x1c\x1d x\x85y z  w"]
    out += ["".join(rng.choices(every, k=rng.randrange(1, 60))) for _ in range(400)]
    out += ["".join(f"a {c} b{c}{c}" for c in every[i : i + 50]) for i in range(0, len(every), 50)]
    out += ["".join(rng.choices("etaoin shrdlu\n,.'", k=400)) for _ in range(50)]
    return out


def test_same_ids_as_tiktoken(oracle):
    coder = bpe.encoder(PATH, P.PATTERN)
    for t in texts():
        ids = coder.encode(t)
        assert ids == oracle.encode_ordinary(t), repr(t)
        assert coder.decode(ids).decode() == t


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h(k) for k in keys) == list(range(5000))
    assert sorted(h.slots) == list(range(5000))
    assert bpe.PerfectHash([b"x"])(b"anything") == 0


def test_round_trip_and_odd_rows(spark, oracle):
    rows = [(1, "some text", "a"), (1, "some text", "a"), (None, None, "b"), (3, "", None), (4, "word " * 40_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.round_trip(docs, PATH, P.PATTERN).toPandas()
    assert got.columns.tolist() == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    for (_, text, _), row in zip(rows, got.itertuples(), strict=True):
        ids = oracle.encode_ordinary(text or "")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_columns(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    kept = bpe.round_trip(docs, PATH, P.PATTERN, keep_ids=True).collect()
    assert [len(r.ids) for r in kept] == [r.n_tokens for r in kept] == [2, 0]
    back = bpe.decoded(bpe.with_ids(docs, PATH, P.PATTERN), PATH, P.PATTERN).toPandas()
    assert [bytes(b) for b in back.decoded] == [b"some text", b""]


def test_remembering_changes_no_ids(oracle, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    coder = bpe.Encoder(bpe.read_ranks(PATH), P.PATTERN)
    for t in texts()[:60] * 2:
        assert coder.encode(t) == oracle.encode_ordinary(t), repr(t)
    assert len(coder.known) <= 3 and len(coder.known.older) <= 3
    assert max(map(len, coder.known)) <= bpe.SHORT


def test_both_splitters_agree():
    coder = bpe.encoder(PATH, P.PATTERN)
    assert coder.split_quick
    rng = random.Random(2)
    first_plane = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    ends = "  \n\t\x1c\x85 　'sre1½٣Aaßñ漢"
    for _ in range(3000):
        t = "".join(rng.choice(ends) if rng.random() < 0.6 else rng.choice(first_plane) for _ in range(rng.randrange(60)))
        assert coder.split_quick(t) == coder.split_any(t), repr(t)
    assert bpe.first_plane_pattern(r"\w+") is None
    assert bpe.first_plane_pattern(r"[a\S]+") is None
