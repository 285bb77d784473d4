"""Byte-level BPE: encode and decode whole texts by the ranks of a vocabulary file.

Each match of the split pattern (a pre-token) is encoded by itself, in two tiers. A minimal perfect hash over the
vocabulary resolves pre-tokens that are in it as a whole. The others start as single bytes in a linked list; a heap
holds the ranks of neighbouring pairs, and the lowest rank, leftmost first, is merged until no pair is
in the vocabulary. That takes n log n steps, so a text without a single split is no problem.

Nothing is shuffled: a partition is read, encoded and handed on in batches of rows. The vocabulary's size bounds
what is sent to the tasks.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens whose ids a worker keeps at hand, twice over (at most 0.2 GB), and the length in characters up to which it keeps one.
REMEMBERED = 400_000
SHORT = 64

#: Up to here the character classes of ``re`` are one lookup.
_PLANE = 0x10000


def read_ranks(path: str) -> dict[bytes, int]:
    """token -> rank of a rank file: lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PerfectHash:
    """A minimal perfect hash of byte strings: hash and displace, one slot for each key.

    Keys are dealt to groups by one hash. From the largest group on, each group gets the first displacement
    that sends its keys to free slots; a group of one key takes a free slot directly, stored as a negative number.
    """

    def __init__(self, keys: list[bytes]):
        self.n = max(1, len(keys))
        self.groups = self.n // 4 + 1
        by_group: dict[int, list[int]] = {}
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            by_group.setdefault(h % self.groups, []).append(i)
        self.moves = array("q", bytes(8 * self.groups))
        self.slots: list[int] = [-1] * self.n
        for b, members in sorted(by_group.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                break
            d = 1
            while True:
                places = {self._slot(hashes[i], d) for i in members}
                if len(places) == len(members) and all(self.slots[p] < 0 for p in places):
                    break
                d += 1
            self.moves[b] = d
            for i in members:
                self.slots[self._slot(hashes[i], d)] = i
        free = (p for p, i in enumerate(self.slots) if i < 0)
        for b, members in by_group.items():
            if len(members) == 1:
                p = next(free)
                self.moves[b], self.slots[p] = -p - 1, members[0]

    def _slot(self, h: int, d: int) -> int:
        return ((h ^ (d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * 0xD6E8FEB86659FD93 >> 32 & 0xFFFFFFFF) % self.n

    def __call__(self, key: bytes) -> int:
        """The index of ``key`` in the keys, if it is one of them; else that of any other."""
        h = xxhash.xxh64_intdigest(key)
        d = self.moves[h % self.groups]
        return self.slots[-d - 1 if d < 0 else self._slot(h, d)]


class Remembered(dict):
    """Pre-token -> ids, computed when first asked for.

    When it is full it becomes the older generation and a new one begins; what is asked for again comes over. So frequent
    pre-tokens stay, however many rare ones pass.
    """

    def __init__(self, compute: Callable[[bytes], tuple[int, ...]]):
        super().__init__()
        self.compute = compute
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.compute(piece.encode())
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def _ranges(escape: str) -> str:
    """The characters of the first plane that an escape like ``\\p{L}`` takes, as ranges of a class."""
    taken = regex.compile(escape).match
    inside = [c for c in range(_PLANE) if not 0xD800 <= c < 0xE000 and taken(chr(c))]
    starts = [c for i, c in enumerate(inside) if not i or inside[i - 1] != c - 1]
    ends = [c for i, c in enumerate(inside) if i + 1 == len(inside) or inside[i + 1] != c + 1]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))


def first_plane_pattern(pattern: str) -> re.Pattern | None:
    """The same pattern for the faster ``re``, for texts without characters beyond the first plane.

    Properties and white space are written as ranges. None if the pattern has escapes that can't be written so.
    """
    out, inside = [], False
    for part in regex.findall(r"\\p\{\w+\}|\\.|\[\^?|.", pattern, flags=regex.DOTALL):
        if part.startswith("\\p") or part == r"\s":
            part = _ranges(part) if inside else f"[{_ranges(part)}]"
        elif part == r"\S" and not inside:
            part = f"[^{_ranges(r'\s')}]"
        elif part.startswith("\\") and part not in (r"\r", r"\n"):
            return None
        elif part.startswith("["):
            if inside:
                return None
            inside = True
        elif part == "]":
            inside = False
        out.append(part)
    try:
        return re.compile("".join(out))
    except re.error:
        return None


class Encoder:
    """Encodes and decodes with one vocabulary and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = list(ranks)
        self.ids = list(ranks.values())
        self.find = PerfectHash(self.tokens)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.shown = {i: str(i) for i in self.ids}
        self.split_any = regex.compile(pattern).findall
        quick = first_plane_pattern(pattern)
        self.split_quick = quick.findall if quick else None
        self.known = Remembered(self.piece)

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a whole text."""
        if self.split_quick and (text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text)):
            return self.split_quick(text)
        return self.split_any(text)

    def piece(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        i = self.find(piece)
        return (self.ids[i],) if self.tokens[i] == piece else self.merged(piece)

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Merge from single bytes, lowest rank first, leftmost of equals."""
        n, rank = len(piece), self.ranks.get
        after, before, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, whole = heappop(heap)
            j = after[i]
            if not size[i] or j >= n or size[i] + size[j] != whole:
                continue  # one of the two has changed since
            size[i], size[j] = whole, 0
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(piece[i : k + size[k]])) is not None:
                    heappush(heap, (r, i, whole + size[k]))
            if (h := before[i]) >= 0 and (r := rank(piece[h : i + whole])) is not None:
                heappush(heap, (r, h, size[h] + whole))
        return tuple(self.ranks[piece[i : i + size[i]]] for i in range(n) if size[i])

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        return list(chain.from_iterable(map(self.known.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a rank file; a worker builds it once."""
    return Encoder(read_ranks(path), pattern)


def with_ids(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text as an int array (null text: no ids)."""

    @F.pandas_udf("array<int>")
    def ids(texts):
        encode = encoder(path, pattern).encode
        return texts.map(lambda t: np.array(encode(t or ""), dtype=np.int32))

    return docs.withColumn(ids_col, ids(F.col(text_col).cast("string")))


def decoded(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes that its ids stand for; an id outside the vocabulary is an error."""

    @F.pandas_udf("binary")
    def run(rows):
        decode = encoder(path, pattern).decode
        return rows.map(lambda x: b"" if x is None else decode(x.tolist()))

    return df.withColumn(bytes_col, run(ids_col))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``keep_ids`` the ids themselves.

    The text is encoded, then its ids are decoded, in one pass over the batch. ids_sha256 is over the decimal
    ids joined by commas, decoded_sha256 over the decoded bytes. A null text counts as empty: no tokens. Repeated
    rows and null doc_ids keep their rows, and other columns are not read.
    """
    columns = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema([*columns, ("ids", pa.list_(pa.int32()))] if keep_ids else columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                n, digests, back, kept = [], [], [], []
                for text in batch.column(1):
                    ids = coder.encode(text.as_py() or "")
                    n.append(len(ids))
                    digests.append(hashlib.sha256(",".join(map(coder.shown.__getitem__, ids)).encode()).hexdigest())
                    back.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                    if keep_ids:
                        kept.append(np.array(ids, dtype=np.int32))
                rows = [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(kept, pa.list_(pa.int32()))] if keep_ids else rows, schema=schema)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
