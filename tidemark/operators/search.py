"""Exact best rows of each group for each query, by products of matrices.

Rows are dealt in ranges of their group and order, so a task holds runs of whole groups or parts of one, however
large a group is.  A task multiplies slices of normed rows with slices of normed queries; what comes near to a query's
k-th best so far is measured again, sum by sum as ``functions.vector`` does, so values and ties are those of the
column expressions.  Of a task only the best k of each group and query go on, and of the slice's equal vectors only
the first k are looked at; nothing grows with rows times queries but the multiplications.

Defined results: ties go to the row that is first in order; a vector that is null, holds a null or has another length
than the query's has a null distance, one of norm 0 NaN; NaN comes after all numbers, null after NaN.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and queries that meet at once, numbers that are measured again at once, rows of a batch that leaves.
SLICE, SOME, AGAIN, OUT = 2048, 256, 2_000_000, 65_536
#: More than products of normed vectors are off (below 100,000 dimensions).
SLACK = 1e-9
#: Query vectors that are sent to executors at once; more go in blocks.
MOST_QUERIES = 10_000
_NAN, _NULL = 1e308, np.inf


def query_blocks(queries: DataFrame, most: int | None = None) -> list[DataFrame]:
    """The queries in blocks of about half of ``most`` (MOST_QUERIES) at most, dealt by a hash."""
    most = most or MOST_QUERIES
    count = queries.count()
    if count <= most:
        return [queries]
    blocks = -(-2 * count // most)
    return [queries.where(F.pmod(F.xxhash64(*queries.columns), F.lit(blocks)) == i) for i in range(blocks)]


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows with rows, summed from the first component on."""
    total = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for i in range(a.shape[1]):
            total += a[:, i] * b[:, i]
    return total


class Vectors:
    """A column of lists: those of one length as a matrix, with norms; ``whole`` tells which have no null."""

    def __init__(self, column: pa.Array):
        flat = column.flatten()
        lost = np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False)) if flat.null_count else np.zeros(0, np.int64)
        values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
        self.sizes = pc.fill_null(column.value_lengths(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        real = np.maximum(self.sizes, 0)
        self.starts, self.values = np.cumsum(real) - real, values
        self.whole = self.sizes >= 0
        if len(lost):
            self.whole[np.searchsorted(self.starts + real, lost, "right")] = False

    def of(self, at: np.ndarray, d: int) -> np.ndarray:
        return self.values[self.starts[at][:, None] + np.arange(d)[None, :]].reshape(len(at), d)


def normed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(norms, rows of norm 1, which rows can be normed)."""
    with np.errstate(all="ignore"):
        norms = np.sqrt(dots(rows, rows))
        fair = np.isfinite(norms) & (norms > 1e-100)
        return norms, np.where(fair[:, None], rows / np.where(fair, norms, 1)[:, None], 0.0), fair


def few_copies(rows: np.ndarray, bonus: np.ndarray, k: int) -> np.ndarray:
    """Places without rows that k equal ones before them stand for."""
    if len(rows) <= k:
        return np.arange(len(rows))
    both = np.ascontiguousarray(np.concatenate((rows, bonus[:, None]), 1))
    _, same = np.unique(both.view(np.dtype((np.void, both.itemsize * both.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    place = np.arange(len(order)) - np.searchsorted(same[order], same[order])
    return np.sort(order[place < k])


class Queries:
    """A block of queries as the driver sends it: names, vectors by length, and the group that each one asks, if any."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.items = table.column("item").combine_chunks()
        self.count = table.num_rows
        self.asks = table.column("ask").to_pylist() if "ask" in table.column_names else None
        self.by_length: dict[int, tuple] = {}
        self.rest = np.arange(0)
        if self.count:
            vectors = Vectors(table.column("query_vector").combine_chunks())
            for d in np.unique(vectors.sizes[vectors.whole]):
                at = np.flatnonzero(vectors.whole & (vectors.sizes == d))
                rows = vectors.of(at, int(d))
                self.by_length[int(d)] = (at, rows, *normed(rows))
        self.of_ask: dict | None = None

    def chosen(self, key: tuple) -> np.ndarray | None:
        """The queries that ask the group of a key (its first part), None for all."""
        if self.asks is None:
            return None
        if self.of_ask is None:
            self.of_ask = {}
            for i, ask in enumerate(self.asks):
                self.of_ask.setdefault(ask, []).append(i)
        return np.array(self.of_ask.get(key[0], []), np.int64)


class Distance:
    """1 - cosine; small is good."""

    def keys(self, dot: np.ndarray, lengths: np.ndarray, bonus: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            keys = 1 - dot / np.where(lengths == 0, np.nan, lengths)
            return np.where(np.isnan(keys), _NAN, keys)

    def near(self, product: np.ndarray, bonus: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = 1 - product
        return keys, keys

    other = _NULL
    values = staticmethod(lambda keys: pa.array(np.where(keys == _NAN, np.nan, keys), mask=keys == _NULL))


class Score:
    """Guarded cosine (-1 for other lengths and vectors of norm 0) of at least a value, plus a row's bonus; large is good."""

    def __init__(self, least: float):
        self.least = least

    def keys(self, dot: np.ndarray, lengths: np.ndarray, bonus: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            cosine = np.where((lengths > 0) | np.isnan(lengths), dot / lengths, -1.0)
            return np.where(np.isnan(cosine), -_NAN, np.where(cosine >= self.least, -(cosine + bonus), np.nan))

    def near(self, product: np.ndarray, bonus: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """About the keys: of what may reach the least value, and of what surely does; else infinite."""
        keys = -(product + bonus[:, None])
        return np.where(product >= self.least - SLACK, keys, np.inf), np.where(product >= self.least + SLACK, keys, np.inf)

    other = None
    values = staticmethod(lambda keys: pa.array(np.where(keys == -_NAN, np.nan, -keys)))


class Best:
    """The k best (key, place) of each query of a group so far, ties to the smaller place."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.count, self.keys, self.places = np.zeros(queries, np.int64), np.full((queries, k), np.inf), np.zeros((queries, k), np.int64)

    def floor(self) -> np.ndarray:
        return np.where(self.count == self.k, self.keys[:, -1], np.inf)

    def add(self, at: np.ndarray, places: np.ndarray, keys: np.ndarray) -> None:
        if not len(at):
            return
        touched = np.unique(at)
        held = np.arange(self.k)[None, :] < self.count[touched, None]
        at = np.concatenate((np.broadcast_to(touched[:, None], held.shape)[held], at))
        places, keys = np.concatenate((self.places[touched][held], places)), np.concatenate((self.keys[touched][held], keys))
        order = np.lexsort((places, keys, at))
        at, places, keys = at[order], places[order], keys[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        keep = rank < self.k
        self.keys[at[keep], rank[keep]], self.places[at[keep], rank[keep]] = keys[keep], places[keep]
        self.count[touched] = np.bincount(np.searchsorted(touched, at[keep]), minlength=len(touched))


class Group:
    """One group's rows as they come in order, against the queries that ask it."""

    def __init__(self, key: tuple, queries: Queries, k: int, measure):
        self.key, self.queries, self.measure, self.seen, self.own = key, queries, measure, 0, []
        chosen = queries.chosen(key)
        self.asked = np.arange(queries.count) if chosen is None else chosen
        self.best = Best(len(self.asked), k)
        place = np.full(queries.count, -1)
        place[self.asked] = np.arange(len(self.asked))
        self.lengths = {}
        for d, (at, *arrays) in queries.by_length.items():
            keep = np.ones(len(at), bool) if chosen is None else place[at] >= 0
            if keep.any():
                self.lengths[d] = (place[at] if chosen is None else place[at[keep]], *(arrays if chosen is None else [x[keep] for x in arrays]))

    def meet(self, own: pa.Array, vectors: Vectors, at: np.ndarray, bonus: np.ndarray) -> None:
        """Rows at places ``at`` of a batch."""
        self.own.append(own)
        whole = vectors.whole[at]
        for d in np.unique(vectors.sizes[at][whole]).tolist():
            mine = np.flatnonzero(whole & (vectors.sizes[at] == d))
            if d in self.lengths and len(mine):
                rows = vectors.of(at[mine], d)
                kept = few_copies(rows, bonus[mine], self.best.k)
                self._same_length(self.lengths[d], rows[kept], bonus[mine][kept], self.seen + mine[kept])
        if self.measure.other is not None:
            self._others(vectors.sizes[at], whole)
        elif self.measure.least <= -1:
            self._others(vectors.sizes[at], whole, bonus)
        self.seen += len(at)

    def _same_length(self, asked: tuple, rows: np.ndarray, bonus: np.ndarray, places: np.ndarray) -> None:
        own, vectors, lengths, unit, fair = asked
        norms, units, rows_fair = normed(rows)
        all_fair = rows_fair.all()
        for start in range(0, len(own), SOME):
            some = slice(start, start + SOME)
            near, sure = self.measure.near(units @ unit[some].T, bonus)
            floor = self.best.floor()[own[some]]
            fresh = np.flatnonzero(np.isinf(floor) & fair[some])
            if len(fresh) and len(rows) > self.best.k:  # k rows of the slice reach it
                sure = sure[:, fresh]
                if not all_fair:
                    sure[~rows_fair] = np.inf
                floor[fresh] = np.partition(sure, self.best.k - 1, axis=0)[self.best.k - 1]
            if not all_fair:
                near[~rows_fair] = -np.inf  # measured in any case
            near[:, ~fair[some]] = -np.inf
            r, q = np.nonzero((near <= floor[None, :] + SLACK) & (near < np.inf))
            step = max(1, AGAIN // max(1, rows.shape[1]))
            for i in range(0, len(r), step):
                a, b = r[i : i + step], q[i : i + step] + start
                keys = self.measure.keys(dots(rows[a], vectors[b]), norms[a] * lengths[b], bonus[a])
                good = ~np.isnan(keys) & (keys <= self.best.floor()[own[b]])
                self.best.add(own[b[good]], places[a[good]], keys[good])

    def _others(self, sizes: np.ndarray, whole: np.ndarray, bonus: np.ndarray | None = None) -> None:
        """Pairs of other lengths or with nulls: the first k (with a bonus: the best k) of them for each query that has too few."""
        width = np.full(len(self.asked), -2)
        for d, (own, *_) in self.lengths.items():
            width[own] = d
        kinds = np.where(whole, sizes, -1)
        for d in np.unique(width).tolist():
            mine = np.flatnonzero(kinds != d)
            lacking = np.flatnonzero((width == d) & (np.isposinf(self.best.floor()) | (bonus is not None)))
            if not len(mine) or not len(lacking):
                continue
            keys = np.full(len(mine), _NULL) if bonus is None else 1.0 - bonus[mine]
            first = np.lexsort((mine, keys))[: self.best.k]
            mine, keys = mine[first], keys[first]
            for i in range(0, len(lacking), SOME):
                part = lacking[i : i + SOME]
                self.best.add(np.repeat(part, len(mine)), np.tile(self.seen + mine, len(part)), np.tile(keys, len(part)))

    def found(self, names: list[str], kinds: list) -> Iterator[pa.RecordBatch]:
        own = pa.concat_arrays(self.own)
        step = max(1, OUT // self.best.k)
        for i in range(0, len(self.asked), step):
            held = np.arange(self.best.k)[None, :] < self.best.count[i : i + step, None]
            n = int(held.sum())
            if n:
                items = self.queries.items.take(pa.array(np.broadcast_to(self.asked[i : i + step, None], held.shape)[held]))
                keys = self.best.keys[i : i + step][held]
                columns = [pa.repeat(pa.scalar(x, kind), n) for x, kind in zip(self.key, kinds)]
                columns += [items, own.take(pa.array(self.best.places[i : i + step][held])), self.measure.values(keys)]
                yield pa.RecordBatch.from_arrays(columns, names)


def _bounds(columns: list[pa.Array]) -> list[int]:
    """Where runs of equal keys start, and the end."""
    n = len(columns[0])
    new = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, max(n - 1, 0))
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(a.is_null(), b.is_null()))
        new |= differ.to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(new) + 1).tolist(), n]


def best_rows(rows: DataFrame, queries: DataFrame, keys: list[str], order: str, k: int, measure, name: str) -> DataFrame:
    """(keys, item, order, ``name``): for each query (item, query_vector) the best k of each group of a task.

    ``rows`` have ``keys``, ``order``, ``embedding`` and, for a score, ``bonus``.  Queries with ``ask`` ask only groups
    whose first key it is.  The union over tasks and blocks holds the best k of each group and query; ranking is left
    to the caller.
    """
    has_bonus = "bonus" in rows.columns
    dealt = rows.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
    dealt = dealt.select(*keys, order, "embedding", *(["bonus"] if has_bonus else []))
    shape = rows.select(*keys).schema
    for f in (queries.schema["item"], rows.schema[order]):
        shape = shape.add(f.name, f.dataType, True)
    shape = shape.add(name, "double", True)
    names, context = shape.names, rows.sparkSession.sparkContext

    def meeting(block: DataFrame) -> DataFrame:
        sent = context.broadcast(Queries(block.toArrow()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, group, kinds = sent.value, None, []
            for batch in batches:
                if not batch.num_rows:
                    continue
                vectors = Vectors(batch.column("embedding"))
                bonus = batch.column("bonus").to_numpy(zero_copy_only=False) if has_bonus else np.zeros(batch.num_rows)
                own, columns = batch.column(order), [batch.column(c) for c in keys]
                kinds, bounds = [c.type for c in columns], _bounds(columns)
                for a, b in zip(bounds, bounds[1:]):
                    key = tuple(c[a].as_py() for c in columns)
                    if group is None or key != group.key:
                        if group:
                            yield from group.found(names, kinds)
                        group = Group(key, asked, k, measure)
                    for i in range(a, b, SLICE):
                        at = np.arange(i, min(b, i + SLICE))
                        group.meet(own.slice(i, len(at)), vectors, at, bonus[at])
            if group:
                yield from group.found(names, kinds)

        return dealt.mapInArrow(run, shape)

    return reduce(DataFrame.unionByName, map(meeting, query_blocks(queries)))
