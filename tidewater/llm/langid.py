"""Language identification by a byte-level convolutional network, written and trained in numpy.

A text's UTF-8 bytes are cut into windows of fixed length. Filters of several widths run over a window's bytes (a
filter of width w adds one learned row for each of w bytes), their maxima over the window go through a
rectifier to a softmax over the languages. A text's prediction is the mean of its windows' logarithms of
probability, weighed by the bytes in them.

The network is fitted on the driver on a bounded sample: about ``SAMPLE`` labelled texts for each language, of each of which the
executors cut ``WINDOWS`` windows. Every label of the training rows is a language. Everything else, each whole text of the
table, is predicted on the executors in one pass without a shuffle; what is sent to them is the network, whose size is fixed by its
parameters and the number of languages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import written

WINDOW = 96
WIDTHS = (2, 3, 4)
FILTERS = 10
SAMPLE = 400
WINDOWS = 6
UNKNOWN = "und"
#: Windows that are scored at a time.
BATCH = 2048


@dataclass
class Network:
    """filters: by width, (width, 256, FILTERS); bias: of the filters; weights, offset: of the softmax."""

    languages: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def features(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The filters' maxima over each window of bytes, and where they are."""
        tops, places = [], []
        for table in self.filters:
            width = len(table)
            n = x.shape[1] - width + 1
            sums = table[0][x[:, :n]]
            for k in range(1, width):
                sums += table[k][x[:, k : k + n]]
            place = sums.argmax(axis=1)
            places.append(place)
            tops.append(np.take_along_axis(sums, place[:, None, :], 1)[:, 0])
        return np.concatenate(tops, axis=1) + self.bias, places

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        scores = np.maximum(self.features(x)[0], 0) @ self.weights + self.offset
        scores -= scores.max(axis=1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def windows(text: bytes, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, the last padded with zero bytes, and the bytes in each."""
    n = max(1, -(-len(text) // window))
    flat = np.zeros(n * window, dtype=np.uint8)
    flat[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    sizes = np.full(n, window, dtype=np.float32)
    sizes[-1] = len(text) - (n - 1) * window
    return flat.reshape(n, window), sizes


def cut(text: bytes, most: int = WINDOWS) -> bytes:
    """Up to ``most`` of a text's windows, in order, chosen by the text alone; a short last window only where it is the only one."""
    n = len(text) // WINDOW
    if n <= most:
        return text[: max(n, 1) * WINDOW]
    pick = np.sort(np.random.default_rng(zlib.crc32(text)).permutation(n)[:most])
    return b"".join(text[i * WINDOW : (i + 1) * WINDOW] for i in pick)


def fit(texts: list[bytes], labels: list[str], seed: int = 7, epochs: int = 6, rate: float = 0.01) -> Network:
    """Train on labelled texts by Adam; the same input gives the same network."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    place = {name: i for i, name in enumerate(languages)}
    xs, ys = [], []
    for text, label in zip(texts, labels, strict=True):
        x, _ = windows(text if isinstance(text, bytes) else text.encode())
        xs.append(x)
        ys.append(np.full(len(x), place[label]))
    k = len(languages)
    net = Network(
        languages,
        [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS), np.float32),
        rng.normal(0, 0.1, (FILTERS * len(WIDTHS), k)).astype(np.float32),
        np.zeros(k, np.float32),
    )
    if not xs:
        return net
    x, y = np.concatenate(xs), np.concatenate(ys)
    params = [*net.filters, net.bias, net.weights, net.offset]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    weight = (len(y) / (k * np.bincount(y, minlength=k)).clip(1)).astype(np.float32)  # languages count alike
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            step += 1
            grads = _gradients(net, x[part], y[part], weight[y[part]])
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    raw, places = net.features(x)
    hidden = np.maximum(raw, 0)
    scores = hidden @ net.weights + net.offset
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    slope = scores / scores.sum(axis=1, keepdims=True)
    slope[np.arange(len(y)), y] -= 1
    slope *= (weight / len(y))[:, None]
    back = (slope @ net.weights.T) * (raw > 0)
    grads, rows = [], np.arange(len(y))[:, None]
    for i, (table, place) in enumerate(zip(net.filters, places, strict=True)):
        own, g = back[:, i * FILTERS : (i + 1) * FILTERS], np.zeros_like(table)
        for w in range(len(table)):
            np.add.at(g[w], (x[rows, place + w], np.arange(FILTERS)[None, :]), own)
        grads.append(g)
    return [*grads, back.sum(axis=0), hidden.T @ slope, slope.sum(axis=0)]


def predict(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language and its probability for each whole text; ``und`` at 0 without a letter."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not net.languages:
        return names, scores
    known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    total = np.zeros((len(texts), len(net.languages)))
    mass = np.zeros(len(texts))
    queue: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = 0

    def score() -> None:
        x, size, owner = (np.concatenate(z) for z in zip(*queue, strict=True))
        for at in range(0, len(x), BATCH):
            part = slice(at, at + BATCH)
            np.add.at(total, owner[part], net.log_probabilities(x[part]) * size[part, None])
        np.add.at(mass, owner, size)
        queue.clear()

    for i in known:
        x, size = windows(texts[i].encode("utf-8", "replace"))
        queue.append((x, size, np.full(len(x), i)))
        waiting += len(x)
        if waiting >= BATCH:
            score()
            waiting = 0
    if queue:
        score()
    for i in known:
        p = np.exp(total[i] / mass[i] - (total[i] / mass[i]).max())
        best = int(p.argmax())
        names[i], scores[i] = net.languages[best], float(p[best] / p.sum())
    return names, scores


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document takes no part in the training: by the CRC-32 of its id's decimal digits."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Network:
    """Fit a network on about ``sample`` texts of each language outside the held-out part, a few windows of each.

    Which ones: those with the smallest hashes of their id and text, by a share for each language that comes from the
    counts of all rows, and twice ``sample`` for each language at most. Null texts, null languages and texts without a letter teach nothing.
    """
    usable = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    usable = usable.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = written(usable.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    u = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    chosen = usable.join(counts, "lang").withColumn("u", u).filter(F.col("u") / float(1 << 30) < sample / F.col("n")).select("u", "lang", F.col("text").cast("binary").alias("text"))
    schema = pa.schema([("u", pa.int64()), ("lang", pa.string()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([cut(t.as_py()) for t in batch.column(2)], pa.binary())], schema=schema)

    # Rows that repeat fall in or out together: the limit bounds what they can add.
    sampled = chosen.mapInArrow(run, "u long, lang string, text binary").orderBy("u", "text", "lang").limit(2 * sample * counts.count())
    rows = [(r["lang"], bytes(r["text"])) for r in sampled.collect()]
    return fit([text for _, text in rows], [lang for lang, _ in rows])


def identified(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    lang_pred is ``und`` and score 0 where the text is null or has no letter, or nothing was learned. Repeated rows and null ids
    keep their rows. No other column is read here.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                names, scores = predict(net, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def kept(docs: DataFrame, net: Network, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of ``least`` or more; columns stay as they are.

    Null and empty texts and texts without a letter go, with any ``least``. Repeated rows and null ids are judged by their text
    like any other; an empty table stays empty.
    """

    @F.pandas_udf("boolean")
    def sure(texts):
        import pandas as pd

        names, scores = predict(net, texts.tolist())
        return pd.Series([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)])

    return docs.filter(sure(F.col("text").cast("string")))
