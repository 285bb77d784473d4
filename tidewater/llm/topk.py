"""Exact top-k by inner product: columnar branch and bound over blocks of dimensions.

Candidates are dealt into groups of bounded size, and each group is laid out vertically, a row of values for each dimension. The
queries, a stated part of the table, are written once, and every group's task reads them from there in tiles: what is shuffled are the
candidates, once. For a tile, dimensions come in blocks from the one with the most mass on. After each block the score so far and
the mass that is left (Cauchy-Schwarz over the remaining dimensions) bound every candidate; those whose upper bound
is below the k-th best lower bound are compacted away. All groups share a first bound for each query: the k-th best score among a
sample of ``SEEDS`` candidates, which are scored in full. What a group finds for a query is at most k rows; the
groups' finds are merged by rank. Work is queries times candidates, as the task is stated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import fresh_path

#: Candidates in a group: what a task lays out at a time.
GROUP = 65_536
#: Candidates under which a group isn't split further to give every core one.
LEAST = 1024
#: Dimensions that are accumulated between two bounds.
BLOCK = 8
#: Queries that a task takes at a time.
TILE = 32
#: Candidates that give the first bounds.
SEEDS = 2048
#: Integers up to this one are exact as floats.
EXACT = 1 << 53


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): v is floor(scale * x) of each component as a long array.

    Rows whose id or vector is null, or whose vector holds a null or non-finite component, are left out. Of rows that
    repeat a vec_id, that with the least vector counts.
    """
    x = F.col("raw")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("raw"))
        .filter(F.col("vec_id").isNotNull() & x.isNotNull())
        .filter(~bad)
    )
    return whole.select("vec_id", F.transform(x, lambda c: F.floor(c * scale)).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _exact(*arrays: np.ndarray) -> bool:
    """Whether all sums of products of the arrays' values are exact in floats."""
    most = [float(np.abs(a.astype(np.float64)).max(initial=0)) for a in arrays]
    return most[0] * most[-1] * max(1, arrays[0].shape[-1]) < EXACT


class Columns:
    """A group of candidates in vertical layout."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.whole = self.rows.astype(np.float64).T.copy()  # dimension by candidate
        self.numbers: np.ndarray | None = None  # the same in integers, where floats aren't exact
        self.squares = np.square(self.whole).sum(axis=0)

    def best(self, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """For each query the ids and scores of its k best candidates that reach its bound, ties to the smaller id; and the values that were read."""
        floats = queries.astype(np.float64)
        columns, asked = self.whole, floats
        if not _exact(queries, self.rows):
            if self.numbers is None:
                self.numbers = np.ascontiguousarray(self.rows.T)
            columns, asked = self.numbers, queries
        d, n = columns.shape
        energy = np.square(floats).sum(axis=0)
        order = np.argsort(-energy, kind="stable")
        mass = np.square(floats[:, order])
        tails = np.concatenate([np.cumsum(mass[:, ::-1], axis=1)[:, ::-1], np.zeros((len(queries), 1))], axis=1)
        first = order[:BLOCK]
        begun = asked[:, first] @ columns[first]
        left_first = self.squares - np.square(self.whole[first]).sum(axis=0)
        for i in range(len(queries)):
            alive = np.flatnonzero(self.ids != query_ids[i])
            score, left, bound, read = begun[i, alive], left_first[alive], float(bounds[i]), len(alive) * min(BLOCK, d)
            for at in range(BLOCK, d, BLOCK):
                # The remaining mass is a difference of sums: what rounding may have taken is added again.
                rest = np.maximum(left, 0.0) + 1e-12 * self.squares[alive]
                reach = np.sqrt(rest * tails[i, at]) * (1 + 1e-9) + 1e-6
                sure, high = score - reach, score + reach
                low = max(bound, np.partition(sure, len(alive) - k)[len(alive) - k]) if len(alive) > k else bound
                keep = high >= low - 1e-6 * abs(low) if bound > -np.inf or len(alive) > k else np.ones(len(alive), dtype=bool)
                if not keep.all():
                    alive, score, left = alive[keep], score[keep], left[keep]
                dims = order[at : at + BLOCK]
                values = self.whole[np.ix_(dims, alive)]
                score = score + asked[i, dims] @ (values if columns is self.whole else columns[np.ix_(dims, alive)])
                left = left - np.square(values).sum(axis=0)
                read += values.size
            score = score.astype(np.int64)
            enough = score >= bound - 1e-6 * abs(bound)  # a long as a float may have been rounded up
            alive, score = alive[enough], score[enough]
            top = np.lexsort((self.ids[alive], -score))[:k]
            yield self.ids[alive[top]], score[top], read


def _matrix(vectors: pa.Array, d: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, d) if d else np.zeros((len(vectors), 0), dtype=np.int64)


def _by_size(ids: np.ndarray, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(d, ids, rows) for each number of dimensions."""
    sizes = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield d, ids[at], _matrix(vectors.take(pa.array(at)), d)


LOWEST = np.iinfo(np.int64).min


def with_bounds(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(vec_id, v, bound): the k-th best score among a sample of the candidates, by the hashes of their ids; the lowest long without k of them."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEEDS).toArrow().combine_chunks()
    seeds = {}
    if sample.num_rows:
        seeds = {d: (ids, rows) for d, ids, rows in _by_size(sample.column("vec_id").to_numpy(), sample.column("v").combine_chunks())}
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("bound", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for d, ids, rows in _by_size(part.column(0).to_numpy(), part.column(1)):
                    bounds = np.full(len(ids), LOWEST)
                    if d in seeds and len(seeds[d][0]) > k:
                        own, values = seeds[d]
                        a, b = (rows.astype(np.float64), values.astype(np.float64)) if _exact(rows, values) else (rows, values)
                        scores = np.where(own[None, :] == ids[:, None], LOWEST, (a @ b.T).astype(np.int64))
                        bounds = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(rows), schema.field(1).type), pa.array(bounds)], schema=schema)

    return queries.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<long>, bound long")


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri("/" + path[5:].lstrip("/") if path.startswith("file:") else path)


def group_finds(vectors: DataFrame, queries: DataFrame, k: int = 5, group: int = GROUP) -> DataFrame:
    """(query_id, vec_id, score, read) of each group's best candidates for each query; read: the values that the group read for it."""
    spark, n = vectors.sparkSession, vectors.count()
    groups = max(1, -(-n // group), min(spark.sparkContext.defaultParallelism, n // LEAST))
    path = fresh_path(spark, "queries")
    with_bounds(queries, vectors, k).write.parquet(path)
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("read", pa.int64())])

    def finds(held: list[Columns]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        for batch in pyarrow.dataset.dataset(root, filesystem=store, format="parquet").to_batches(batch_size=4096):
            out = ([], [], [], [])
            for d, ids, rows in _by_size(np.arange(batch.num_rows), batch.column("v")):
                query_ids, bounds = batch.column("vec_id").to_numpy()[ids], batch.column("bound").to_numpy()[ids]
                for columns in held:
                    if columns.rows.shape[1] != d:
                        continue
                    for at in range(0, len(ids), TILE):
                        tile = slice(at, at + TILE)
                        for q, (found, score, read) in zip(query_ids[tile], columns.best(query_ids[tile], rows[tile], np.where(bounds[tile] == LOWEST, -np.inf, bounds[tile]), k), strict=True):
                            for x, y in zip(out, (np.full(len(found), q), found, score, np.full(len(found), read)), strict=True):
                                x.append(y)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lists, n = [], [], 0

        def laid_out() -> list[Columns]:
            return [Columns(i, rows) for _, i, rows in _by_size(np.concatenate(ids), pa.concat_arrays(lists))]

        for batch in batches:
            ids.append(batch.column(0).to_numpy())
            lists.append(batch.column(1))
            n += batch.num_rows
            if n >= group:
                yield from finds(laid_out())
                ids, lists, n = [], [], 0
        if n:
            yield from finds(laid_out())

    dealt = vectors.select("vec_id", "v").repartition(groups, F.xxhash64("vec_id"))
    return dealt.mapInArrow(run, "query_id long, vec_id long, score long, read long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k highest inner products with ``vectors``.

    Both have vec_id and v, a long array, as ``quantised`` gives them, and are cheap to read twice. A query is compared with the
    candidates of as many dimensions, but for that with its own vec_id. Ties go to the smaller vec_id; a query with fewer
    candidates gets fewer rows. Scores are exact as long as they fit into a long.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        group_finds(vectors, queries, k, group)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
