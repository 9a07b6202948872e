"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Each vector o, less the mean c of all vectors, is turned by a random rotation (rounds of sign flips and
Walsh-Hadamard transforms, from a seed) into twice its dimensions or more, and keeps one bit for each, its sign.
With it go three correction scalars: its length |o - c|, the cosine between it and its code, and <o, c>.

A query, less c and turned alike, becomes planes of bits, so that its product with a code is a few counts of
common bits.  Divided by the code's cosine this estimates <o - c, q - c>; the error has a standard deviation of
|o - c| |q - c| sqrt(1 / cosine^2 - 1) / sqrt(bits - 1), to which the exact rounding of the planes is added.
Where the estimate and ``ERRORS`` such deviations reach the query's k-th best so far, the vector is reranked by its
exact inner product in double precision; so what comes back has exact scores, and recall is set by ``ERRORS``.

The index is a table of packed codes, scalars and vectors, written once; making it shuffles nothing.  Queries are
taken in blocks of bounded size (broadcast); each block runs against all rows, and the best k of a task leave it.
Of equal vectors that meet in a bucket only the k + 1 with the smallest ids are looked at, which loses nothing.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components take no part, nor do
rows without id; a query meets only vectors of its own dimension; a repeated id is a row of its own, and each row
that asks is a query, whose candidates are all rows but itself; ties go to the smaller id; fewer candidates than
k give fewer rows; a very long vector makes query blocks smaller; an empty table gives no rows; further columns
are ignored.  Products beyond the range of a double are infinite, and come first or last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import list_rows, merged_in_a_tree, release, settle

K = 20
#: Standard deviations of the estimate that a vector gets before it is passed over.
ERRORS = 3.0
ROUNDS, SEED = 3, 20
#: Bits of a query's component.
PLANES = 6
QUERY_BLOCK = 32_768
#: Numbers in a query block, whatever the dimension (64 MB).
MOST_NUMBERS = 8_000_000
#: Vectors and queries that meet at once; numbers of the pairs reranked at once.
BUCKET, SOME, RERANK = 2048, 64, 4_000_000

INDEX = "own long, vec_id long, dim int, vector binary, code binary, length double, cosine double, centre double"
FOUND = "asker long, query_id long, vec_id long, score double"


def code_bits(d: int) -> int:
    """The power of two from 2 d and from 64 on."""
    return max(64, 1 << (2 * d - 1).bit_length())


def rotated(rows: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The rows, with zeros up to the bits of their code, turned at random; lengths and angles stay."""
    n, d = rows.shape
    bits = code_bits(d)
    signs = np.random.default_rng((seed, bits)).choice((-1.0, 1.0), (ROUNDS, bits))
    out = np.zeros((n, bits))
    out[:, :d] = rows
    for flips in signs:
        out *= flips / np.sqrt(bits)
        half = 1
        while half < bits:
            pairs = out.reshape(n, -1, 2, half)
            out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), 2).reshape(n, bits)
            half *= 2
    return out


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    return np.packbits(bits, axis=-1).view(np.uint64)


class Codes:
    """The codes and correction scalars of vectors, and what they estimate."""

    def __init__(self, code: np.ndarray, length: np.ndarray, cosine: np.ndarray, centre: np.ndarray):
        self.code, self.length, self.cosine, self.centre = code, length, cosine, centre

    @classmethod
    def of(cls, rows: np.ndarray, mean: np.ndarray) -> "Codes":
        apart = rows - mean
        length = np.sqrt((apart * apart).sum(1))
        turned = rotated(apart / np.where(length > 0, length, 1)[:, None])
        cosine = np.abs(turned).sum(1) / np.sqrt(turned.shape[1])
        return cls(packed(turned > 0), length, np.where(length > 0, cosine, 1.0), rows @ mean)

    def take(self, at) -> "Codes":
        return Codes(self.code[at], self.length[at], self.cosine[at], self.centre[at])


class Queries:
    """A block of queries of one dimension, in double precision and as planes of bits."""

    def __init__(self, own: np.ndarray, rows: np.ndarray, mean: np.ndarray):
        self.own, self.rows = own, rows
        apart = rows - mean
        self.length = np.sqrt((apart * apart).sum(1))
        self.base = apart @ mean  # <q, c> - |c|^2
        turned = rotated(apart)
        self.bits = turned.shape[1]
        self.low = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.low) / ((1 << PLANES) - 1), 1e-300)
        steps = np.clip(np.rint((turned - self.low[:, None]) / self.step[:, None]), 0, (1 << PLANES) - 1).astype(np.int64)
        self.total = steps.sum(1)
        self.slack = np.abs(turned - (self.low[:, None] + self.step[:, None] * steps)).sum(1) / np.sqrt(self.bits)
        self.planes = np.stack([packed((steps >> j & 1).astype(bool)) for j in range(PLANES)])

    def estimates(self, some: slice, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
        """(estimate, error bound) of the inner product of each query of ``some`` with each code."""
        shared = np.zeros((len(self.own[some]), len(codes.code)), np.int32)
        for j in range(PLANES):
            for w in range(codes.code.shape[1]):
                shared += np.bitwise_count(self.planes[j, some, w, None] & codes.code[None, :, w]).astype(np.int32) << j
        ones = np.bitwise_count(codes.code).sum(1, dtype=np.int64)
        step, low = self.step[some, None], self.low[some, None]
        product = (low * (2 * ones - self.bits) + step * (2 * shared - self.total[some, None])) / np.sqrt(self.bits)
        scale = codes.length / codes.cosine
        wide = codes.length * np.sqrt(np.maximum(1 / codes.cosine**2 - 1, 0) / (self.bits - 1)) * ERRORS
        return codes.centre + self.base[some, None] + scale * product, scale * self.slack[some, None] + wide * self.length[some, None]


class Best:
    """The k best (score, id) of each query so far, best first; ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.count = k, np.zeros(queries, np.int64)
        self.scores, self.ids = np.full((queries, k), -np.inf), np.zeros((queries, k), np.int64)

    def floor(self) -> np.ndarray:
        return np.where(self.count == self.k, self.scores[:, -1], -np.inf)

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Offer scores[i] of candidate ids[i] to query at[i]."""
        touched = np.unique(at)
        held = np.arange(self.k)[None, :] < self.count[touched, None]
        at = np.concatenate((np.broadcast_to(touched[:, None], held.shape)[held], at))
        ids, scores = np.concatenate((self.ids[touched][held], ids)), np.concatenate((self.scores[touched][held], scores))
        order = np.lexsort((ids, -scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = place < self.k
        self.scores[at[keep], place[keep]], self.ids[at[keep], place[keep]] = scores[keep], ids[keep]
        self.count[touched] = np.bincount(np.searchsorted(touched, at[keep]), minlength=len(touched))


def exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows; the same for the same two vectors, wherever they stand."""
    return (queries * rows).sum(1)


def few_copies(rows: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places without vectors that k + 1 or more equal ones with smaller ids stand for."""
    _, same = np.unique(np.ascontiguousarray(rows).view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    place = np.arange(len(order)) - np.searchsorted(same[order], same[order])
    return np.sort(order[place <= k])


def meet(queries: Queries, best: Best, own: np.ndarray, ids: np.ndarray, rows: np.ndarray, codes: Codes) -> int:
    """Let each query meet a bucket; the number of vectors reranked."""
    reranked = 0
    at = few_copies(rows, ids, best.k)
    own, ids, rows, codes = own[at], ids[at], rows[at], codes.take(at)

    def rerank(q: np.ndarray, o: np.ndarray) -> None:
        step = max(1, RERANK // rows.shape[1])
        for i in range(0, len(q), step):
            a, b = q[i : i + step], o[i : i + step]
            scores = exact(queries.rows[a], rows[b])
            good = ~np.isnan(scores) & (scores >= best.floor()[a])
            if good.any():
                best.add(a[good], ids[b[good]], scores[good])

    for start in range(0, len(queries.own), SOME):
        some = slice(start, start + SOME)
        with np.errstate(over="ignore", invalid="ignore"):
            estimate, bound = queries.estimates(some, codes)
            upper = np.nan_to_num(estimate + bound, nan=np.inf, posinf=np.inf)
            upper[queries.own[some][:, None] == own[None, :]] = -np.inf
            fresh = np.nonzero(best.count[some] < best.k)[0]
            if len(fresh):  # the likeliest first, which give a floor
                likely = np.argpartition(-upper[fresh], min(best.k, upper.shape[1]) - 1, axis=1)[:, : best.k]
                q, o = np.repeat(fresh, likely.shape[1]), likely.ravel()
                real = upper[q, o] > -np.inf
                rerank(q[real] + start, o[real])
                upper[q, o] = -np.inf
            q, o = np.nonzero((upper >= best.floor()[some, None]) & (upper > -np.inf))
            rerank(q + start, o)
        reranked += len(q)
    return reranked


def _vectors(dims: np.ndarray, column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, places, vectors) of packed vectors."""
    held = np.array(column.to_pylist(), object)
    widths = np.array([len(x) for x in held], np.int64) // np.maximum(dims, 1)
    for d, width in sorted({*zip(dims.tolist(), widths.tolist())}):
        at = np.nonzero((dims == d) & (widths == width))[0]
        yield d, at, np.frombuffer(b"".join(held[at]), f"<f{width}").reshape(-1, d).astype(float)


def _means(batches) -> dict:
    found: dict[int, tuple] = {}
    for batch in batches:
        for d, _, rows in list_rows(batch.column("v")):
            n, total = found.get(d, (0, 0.0))
            found[d] = (n + len(rows), total + rows.sum(0))
    return found


def _encode(means: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, rows in list_rows(batch.column("v")):
                step = max(1, (1 << 20) // d)
                for i in range(0, len(at), step):
                    part, places = rows[i : i + step], pa.array(at[i : i + step])
                    with np.errstate(over="ignore", invalid="ignore"):
                        codes, small = Codes.of(part, means[d]), part.astype("<f4")
                    narrow = (small == part).all(1)  # as floats where that loses nothing
                    vectors = [(s if n else p).tobytes() for s, p, n in zip(small, part, narrow)]
                    columns = [batch.column("own").take(places), batch.column("vec_id").take(places), pa.array(np.full(len(part), d, np.int32))]
                    columns += [pa.array(vectors, pa.binary()), pa.array([c.tobytes() for c in codes.code], pa.binary())]
                    columns += [pa.array(c) for c in (codes.length, codes.cosine, codes.centre)]
                    yield pa.RecordBatch.from_arrays(columns, ["own", "vec_id", "dim", "vector", "code", "length", "cosine", "centre"])
        release()

    return run


def index(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, dict[int, np.ndarray]]:
    """The coded vectors that take part, as a written table, and the mean of each dimension."""
    numbers = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    listed = vectors.select(F.col(id_column).cast("long").alias("vec_id"), numbers.alias("v"))
    sound = F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    listed = listed.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    told = merged_in_a_tree(listed.select("v"), _means, lambda a, b: (a[0] + b[0], a[1] + b[1]))
    # rounded, so that the order of the sums can't change a code; any centre near the mean does
    means = {d: np.nan_to_num(total / n, nan=0, posinf=0, neginf=0).astype(np.float32).astype(float) for d, (n, total) in told.items()}
    return settle(listed.withColumn("own", F.monotonically_increasing_id()).mapInArrow(_encode(means), INDEX)), means


def _search(blocks: dict, means: dict[int, np.ndarray], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {d: (sent.value[1], Queries(sent.value[0], sent.value[2], means[d]), Best(len(sent.value[0]), k)) for d, sent in blocks.items()}
        for batch in batches:
            own, ids, dims, length, cosine, centre = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("own", "vec_id", "dim", "length", "cosine", "centre"))
            code = np.array(batch.column("code").to_pylist(), object)
            for d, at, rows in _vectors(dims, batch.column("vector")):
                if d in asked:
                    codes = Codes(np.frombuffer(b"".join(code[at]), np.uint64).reshape(len(at), -1), length[at], cosine[at], centre[at])
                    for i in range(0, len(at), BUCKET):
                        part = slice(i, i + BUCKET)
                        meet(*asked[d][1:], own[at[part]], ids[at[part]], rows[part], codes.take(part))
        for names, queries, best in asked.values():
            for i in range(0, len(names), 4096):
                q, place = np.nonzero(np.arange(k)[None, :] < best.count[i : i + 4096, None])
                columns = [queries.own[q + i], names[q + i], best.ids[q + i, place], best.scores[q + i, place]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["asker", "query_id", "vec_id", "score"])
        release()

    return run


def search(coded: DataFrame, means: dict[int, np.ndarray], asks: Column, k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found; ``asks`` says by ``vec_id`` which rows of the index ask."""
    spark = coded.sparkSession
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = coded.where(asks).select("own", "vec_id", "dim", "vector")
    count, widest = asked.agg(F.count("*"), F.max("dim")).first()
    blocks = -(-count * 5 // (4 * max(64, min(query_block, MOST_NUMBERS // widest)))) if count else 0  # hashed, so some slack
    for i in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("own"), F.lit(blocks)) == i).toArrow()
        own, ids, dims = (block.column(c).to_numpy() for c in ("own", "vec_id", "dim"))
        parts: dict[int, list] = {}
        for d, at, rows in _vectors(dims, block.column("vector")):
            parts.setdefault(d, []).append((own[at], ids[at], rows))
        sent = {d: spark.sparkContext.broadcast(tuple(map(np.concatenate, zip(*some)))) for d, some in parts.items()}
        by_score = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
        ranked = coded.mapInArrow(_search(sent, means, k), FOUND).withColumn("rank", F.row_number().over(by_score))
        ranked = ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:
            ranked = settle(ranked)
            for shared in sent.values():
                shared.destroy()
        out = out.unionByName(ranked)
    return out


def nearest(vectors: DataFrame, asks: Column, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """Index the vectors and search them for the rows that ask."""
    return search(*index(vectors, id_column, vector_column), asks, k, query_block)
