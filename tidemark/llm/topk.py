"""Exact top-k inner products by norm buckets and local cosine thresholds.

Vectors are dealt into ranges of length (Euclidean norm); a run of at most ``BUCKET`` neighbours in a
range is a bucket.  A query starts with a lower bound on its k-th best score, from the longest vectors.
In a bucket whose longest vector has length l, a candidate can only reach a query's bound t if their
cosine is at least the local threshold t / (|q| l):

* above 1, the bucket is skipped for that query;
* from ``COORDINATE_FROM`` on, coordinates prune: Cauchy-Schwarz on the query's largest coordinates and
  the rest bounds the product, and only candidates that the bound leaves are verified;
* below, only length prunes: candidates shorter than t / |q| are left out.

What remains is verified with exact integer products.  Bounds rise while a partition is read.  Queries
are taken in blocks of at most ``QUERY_BLOCK`` (a broadcast of bounded size); each block runs against all
vectors, and only the best k of a partition leave it.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do
rows without id; a query meets only vectors of its own dimension; a repeated id is a row of its own: each
row that asks is a query (those of one id give their rows each), and every row but the query's own is a candidate,
those of the same id too; ties go to the smaller id; fewer candidates than k give fewer rows; a very long
vector makes query blocks smaller; further columns are ignored.
Components beyond 2^24 are computed with Python's whole numbers; scores must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, settle_as_dealt

K = 20
QUERY_BLOCK = 32_768
BUCKET = 4096
#: Whole numbers in a query block, whatever the dimension (64 MB).
MOST_NUMBERS = 8_000_000
#: Longest vectors that give each query its first bound.
FIRST_VECTORS = 4096
#: Rows of a length range; one partition each.
RANGE_ROWS = 16_384
COORDINATE_FROM = 0.6
COORDINATES = 16
#: Products of components up to this size add up exactly in doubles for up to 2^4 thousand dimensions.
EXACT = 1 << 20
NONE = np.iinfo(np.int64).min

SCHEMA = "asker long, query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, asks: Column, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 64) -> DataFrame:
    """(own, vec_id, ints array<long>, asks boolean, norm double) of the vectors that take part; ``own`` tells rows apart."""
    parts = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    sound = F.size(parts) > 0
    sound &= ~F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = vectors.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull()).where(sound)
    out = out.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(parts, lambda x: F.floor(x * scale)).alias("ints"), F.coalesce(asks, F.lit(False)).alias("asks"))
    squares = F.aggregate("ints", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return out.withColumn("norm", F.sqrt(squares)).withColumn("own", F.monotonically_increasing_id())


class Best:
    """The best k (score, id) of each query so far, best first."""

    def __init__(self, queries: int, k: int):
        self.scores = np.full((queries, k), NONE, np.int64)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max, np.int64)

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Offer scores[i, j] of candidate ids[j] to query at[i]; NONE offers nothing.  ids ascend."""
        k = self.scores.shape[1]
        if scores.shape[1] > k:
            # of equal scores the stable order keeps the smaller ids
            if scores.shape[1] > 4 * k:
                least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
                ties = scores == least[:, None]
                room = k - (scores > least[:, None]).sum(1)
                take = (scores > least[:, None]) | (ties & (np.cumsum(ties, axis=1) <= room[:, None]))
                place = np.nonzero(take)[1].reshape(len(scores), k)
            else:
                place = np.argsort(~scores, axis=1, kind="stable")[:, :k]
            scores, own = np.take_along_axis(scores, place, 1), ids[place]
        else:
            own = np.broadcast_to(ids, scores.shape)
        own = np.where(scores == NONE, np.iinfo(np.int64).max, own)
        all_scores, all_ids = np.concatenate((self.scores[at], scores), 1), np.concatenate((self.ids[at], own), 1)
        order = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]
        self.scores[at], self.ids[at] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)


class Queries:
    """A block of queries of one dimension, with what pruning needs; ``own`` tells their rows apart."""

    def __init__(self, own: np.ndarray, ints: np.ndarray, k: int):
        self.own, self.k = own, k
        self.exact = bool(np.abs(ints).max(initial=0) < EXACT)
        self.ints = ints if not self.exact else ints.astype(np.float64)
        wide = ints.astype(np.float64)
        self.norms = np.sqrt((wide * wide).sum(1))
        focus = min(COORDINATES, ints.shape[1])
        self.order = np.argsort(-np.abs(wide).sum(0), kind="stable")[:focus]  # the block's heaviest coordinates
        self.head = wide[:, self.order]
        self.tail = np.sqrt(np.maximum((wide * wide).sum(1) - (self.head * self.head).sum(1), 0))

    def products(self, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.exact and np.abs(rows).max(initial=0) < EXACT:
            return (self.ints[at] @ rows.T.astype(np.float64)).astype(np.int64)
        return (self.ints[at].astype(np.int64).astype(object) @ rows.T.astype(object)).astype(np.int64)

    def bucket(self, best: Best, floor: np.ndarray, ids: np.ndarray, rows: np.ndarray, own: np.ndarray | None = None, block: int = 1024) -> None:
        """Offer a bucket; floor: a score that each query's k-th best reaches at least (NONE: unknown); own: ids if None."""
        order = np.argsort(ids, kind="stable")
        ids, rows, own = ids[order], rows[order], (ids if own is None else own)[order]
        wide = rows.astype(np.float64)
        lengths = np.sqrt((wide * wide).sum(1))
        bound = np.maximum(floor, best.scores[:, -1])
        known = bound != NONE
        reach = self.norms * lengths.max() * (1 + 1e-9) + 1e-6
        alive = ~known | (bound <= reach)
        cosine = np.where(known & (reach > 0), bound / np.maximum(reach, 1e-300), -1.0)
        by_coordinate = alive & (cosine >= COORDINATE_FROM)
        for chosen, coordinate in ((alive & ~by_coordinate, False), (by_coordinate, True)):
            for start in range(0, len(at := np.nonzero(chosen)[0]), block):
                some = at[start : start + block]
                mine, keep = bound[some], np.ones(len(ids), bool)
                if known[some].all():
                    least = np.maximum(mine, 0) / np.maximum(self.norms[some], 1e-300)
                    keep = lengths * (1 + 1e-9) + 1e-6 >= least.min()
                if coordinate:
                    head = wide[:, self.order]
                    tail = np.sqrt(np.maximum(lengths**2 - (head * head).sum(1), 0))
                    top = self.head[some] @ head.T + np.outer(self.tail[some], tail)
                    keep &= (top * (1 + np.sign(top) * 1e-9) + 1e-6 >= mine[:, None]).any(0)
                if not keep.any():
                    continue
                scores = self.products(some, rows[keep])
                scores[scores < mine[:, None]] = NONE
                scores[self.own[some][:, None] == own[keep][None, :]] = NONE
                worth = (scores != NONE).any(1)
                if worth.any():
                    best.add(some[worth], ids[keep], scores[worth])


def _arrays(batch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(own, ids, rows) of a batch with columns own, vec_id and ints, for each dimension in it."""
    own, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("own", "vec_id"))
    lists = batch.column("ints")
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        at = np.nonzero(sizes == d)[0]
        yield own[at], ids[at], flat[starts[at][:, None] + np.arange(d)[None, :]]


def _search(blocks: dict, floors: dict, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {}
        for d, q in blocks.items():
            asker, asked, ints = q.value
            state[d] = (Queries(asker, ints, k), asked, floors[d].value if d in floors else np.full(len(asker), NONE), Best(len(asker), k))
        for batch in batches:
            for own, ids, rows in _arrays(batch):
                if rows.shape[1] not in state:
                    continue
                queries, _, floor, best = state[rows.shape[1]]
                for i in range(0, len(ids), BUCKET):
                    queries.bucket(best, floor, ids[i : i + BUCKET], rows[i : i + BUCKET], own[i : i + BUCKET])
        for queries, asked, _, best in state.values():
            real = best.scores != NONE
            columns = [np.broadcast_to(queries.own[:, None], real.shape), np.broadcast_to(asked[:, None], real.shape), best.ids, best.scores]
            for i in range(0, len(real), 4096):
                r = real[i : i + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 4096][r], pa.int64()) for c in columns], ["asker", "query_id", "vec_id", "score"])

    return run


def _by_dimension(collected: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return {rows.shape[1]: (own, ids, rows) for batch in collected.combine_chunks().to_batches() for own, ids, rows in _arrays(batch)}


def _query_blocks(rows: DataFrame, most: int) -> Iterator[tuple[int, dict]]:
    """(number of blocks, {dimension: (own, ids, ints)}) for each block of queries."""
    asked = settle(rows.where("asks").select("own", "vec_id", "ints"))
    count, widest = asked.agg(F.count("*"), F.max(F.size("ints"))).first()
    if not count:
        return
    most = max(64, min(most, MOST_NUMBERS // widest))
    blocks = -(-count * 5 // (4 * most))  # hashed, so some slack below the bound
    for i in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("own"), F.lit(blocks)) == i).toArrow()
        yield blocks, _by_dimension(block)


def top_k(vectors: DataFrame, asks: Column, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 64, query_block: int = QUERY_BLOCK, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best inner products; ``asks`` says which rows ask."""
    spark = vectors.sparkSession
    rows = quantised(vectors, asks, id_column, vector_column, scale)
    parts = max(1, vectors.count() // range_rows)
    dealt = rows.repartitionByRange(parts, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    rows = settle_as_dealt(dealt)
    first = rows.orderBy(F.desc("norm"), "vec_id").limit(FIRST_VECTORS).select("own", "vec_id", "ints").toArrow()
    longest = _by_dimension(first)
    by_score = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for blocks, block in _query_blocks(rows, query_block):
        shared, floors = {}, {}
        for d, (asker, asked, ints) in block.items():
            if d in longest:
                queries, best = Queries(asker, ints, k), Best(len(asker), k)
                own, ids, vectors_d = longest[d]
                queries.bucket(best, np.full(len(asker), NONE), ids, vectors_d, own)
                floors[d] = spark.sparkContext.broadcast(best.scores[:, -1].copy())
            shared[d] = spark.sparkContext.broadcast((asker, asked, ints))
        found = rows.select("own", "vec_id", "ints").mapInArrow(_search(shared, floors, k), SCHEMA)
        ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:
            ranked = settle(ranked)
            for sent in (*shared.values(), *floors.values()):
                sent.destroy()
        out = out.unionByName(ranked)
    return out


#: The rows of op10 in DuckDB SQL.
ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS ints FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.ints, c.ints) AS BIGINT) AS score
  FROM v q JOIN v c ON q.own <> c.own AND len(q.ints) = len(c.ints) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
