"""Whitening of embeddings by a covariance in two passes.

Components become whole numbers, so the sums of the first pass, and with them the means, are exact.  The second
pass sums outer products of centred vectors, a matrix product for each Arrow batch; both merge in a tree on the
executors.  LAPACK's symmetric solver gives the components, and a projection of a few columns is broadcast.
A third pass measures how far the covariance of the whitened fit list is from the identity.

The fit list holds each distinct vector once, so a vector's copies count once; it is a table of packed vectors,
and what is shuffled to make it are those, without copies inside a task.

Defined results: vectors that are null, hold null or non-finite entries, or entries whose whole number is beyond
2^62, take no part; empty vectors have no components, so no rows; vectors of each length are fitted by themselves;
a null id stays null; repeated rows each give their rows; an empty table gives no rows; further columns are
ignored.  A component without variance (beyond rounding: fewer distinct vectors than dimensions, or constant ones)
is 0 for all rows, explains 0, and takes no part in ``identity_error``, which is 0 where there is none.
``deviation`` is null where it has more than 38 digits.  A length above ``MOST_DIMENSIONS`` with two or more
distinct vectors is an error: its covariance must fit one worker and the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import list_rows, merged_in_a_tree, release, settle

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
LARGEST = 1 << 62
MOST_DIMENSIONS = 16_384
#: Whole numbers in a slice of vectors that is unpacked at once.
SLICE = 1 << 20


@dataclass
class Fit:
    """What the fit list of one length says; whole numbers are without OFFSET, which centring takes away."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors as columns
    trace: float
    identity_error: float = 0.0

    def deviations(self, rows: np.ndarray) -> np.ndarray:
        return deviations(rows, self.n, self.sums)

    def projection(self, components: int) -> np.ndarray:
        """Columns that whiten a centred vector; zero where there is no variance."""
        values = self.values[:components]
        live = self.live(components)
        return np.where(live, self.vectors[:, :components] / np.sqrt(np.where(live, values, 1.0)), 0.0)

    def live(self, components: int) -> np.ndarray:
        values = self.values[:components]
        return values > max(self.values[0], 0) * len(self.values) * np.finfo(float).eps

    def explained(self, components: int) -> np.ndarray:
        return np.where(self.live(components), self.values[:components] / (self.trace or 1.0), 0.0)


def deviations(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: long where it fits, else Python's whole numbers."""
    if n * int(np.abs(rows).max(initial=0)) + max(map(abs, sums), default=0) < LARGEST:
        return rows * n - np.array(sums, np.int64)
    return rows.astype(object) * n - np.array(sums, object)


def squares(deviation: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    if deviation.dtype == object:
        return [sum(x * x for x in row) for row in deviation]
    if int(np.abs(deviation).max(initial=0)) ** 2 * deviation.shape[1] < 1 << 63:
        return (deviation * deviation).sum(1).tolist()
    low, mid, high = deviation & 0x1FFFFF, (deviation >> 21) & 0x1FFFFF, deviation >> 42  # sums of products of 21 bits fit a long
    parts = [(low * low, 0), (2 * low * mid, 21), (mid * mid + 2 * low * high, 42), (2 * mid * high, 63), (high * high, 84)]
    return list(map(sum, zip(*([int(x) << shift for x in part.sum(1)] for part, shift in parts))))


def _whole(column, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, whole numbers) of the sound vectors of an Arrow column of lists of doubles."""
    with np.errstate(over="ignore"):
        for d, at, rows in list_rows(column):
            floor = np.floor(rows * scale)
            sound = (np.abs(floor) < LARGEST).all(1)
            yield d, at[sound], floor[sound].astype(np.int64)


def _pack(scale: int):
    """Vectors as (dim, x): whole numbers in the narrowest of 2, 4 and 8 bytes, so equal vectors are equal bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, _, rows in _whole(batch.column("v"), scale):
                most = np.abs(rows).max(1)
                for kind, least, below in (("<i2", 0, 1 << 15), ("<i4", 1 << 15, 1 << 31), ("<i8", 1 << 31, LARGEST + 1)):
                    some = rows[(most >= least) & (most < below)].astype(kind)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), d, np.int32)), pa.array([x.tobytes() for x in some], pa.binary())], ["dim", "x"])
        release()

    return run


def _unpacked(batches) -> Iterator[tuple[int, np.ndarray]]:
    for whole in batches:
        dims = whole.column("dim").to_numpy(zero_copy_only=False)
        packed = np.array(whole.column("x").to_pylist(), object)
        widths = np.array([len(x) for x in packed], np.int64) // np.maximum(dims, 1)
        for d, width in {*zip(dims.tolist(), widths.tolist())}:
            some, step = packed[(dims == d) & (widths == width)], max(1, SLICE // d)
            for i in range(0, len(some), step):
                yield d, np.frombuffer(b"".join(some[i : i + step]), f"<i{width}").reshape(-1, d).astype(np.int64)


def _add(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b))


def _sums(batches) -> dict:
    found: dict[int, tuple] = {}
    for d, rows in _unpacked(batches):
        halves = ((rows >> 31).sum(0).astype(object) << 31) + (rows & 0x7FFFFFFF).sum(0).astype(object)  # no slice overflows
        part = (len(rows), halves)
        found[d] = _add(found[d], part) if d in found else part
    return found


def _products(told: dict[int, tuple]):
    def work(batches) -> dict:
        found: dict[int, tuple] = {}
        for d, rows in _unpacked(batches):
            n, sums = told[d]
            if n > 1:
                centred = deviations(rows, n, sums).astype(float) / n
                part = (centred.T @ centred,)
                found[d] = _add(found[d], part) if d in found else part
        return found

    return work


def _joint(a: tuple, b: tuple) -> tuple:
    """(count, mean, centred products) of two parts together."""
    (n, mean, products), (m, other, more) = a, b
    apart = other - mean
    return n + m, mean + apart * (m / (n + m)), products + more + np.outer(apart, apart) * (n * m / (n + m))


def _whitened(fits: dict[int, Fit], components: int):
    def work(batches) -> dict:
        found: dict[int, tuple] = {}
        for d, rows in _unpacked(batches):
            fit = fits[d]
            white = fit.deviations(rows).astype(float) / fit.n @ fit.projection(components)
            centred = white - white.mean(0)
            part = (len(white), white.mean(0), centred.T @ centred)
            found[d] = _joint(found[d], part) if d in found else part
        return found

    return work


def fit(vectors: DataFrame, vector: Column, components: int = COMPONENTS, scale: int = SCALE) -> dict[int, Fit]:
    """The fit of each length of vector."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    packed = vectors.select(numbers.alias("v")).where("v IS NOT NULL").mapInArrow(_pack(scale), "dim int, x binary")
    listed = settle(packed.distinct())
    told = {d: (n, [int(s) for s in sums]) for d, (n, sums) in merged_in_a_tree(listed, _sums, _add).items()}
    large = [d for d, (n, _) in told.items() if n > 1 and d > MOST_DIMENSIONS]
    if large:
        raise ValueError(f"vectors of {max(large)} dimensions; a covariance is made for at most {MOST_DIMENSIONS}")
    products = merged_in_a_tree(listed, _products(told), _add)
    fits = {}
    for d, (n, sums) in told.items():
        if n == 1:  # no variance
            fits[d] = Fit(1, sums, np.zeros(d), np.eye(d, min(d, components)), 0.0)
            continue
        covariance = products[d][0] / n
        values, columns = np.linalg.eigh((covariance + covariance.T) / 2)
        values, columns = values[::-1], columns[:, ::-1]
        heavy = np.take_along_axis(columns, np.abs(columns).argmax(0)[None, :], 0)  # its sign is made positive
        fits[d] = Fit(n, sums, values, columns * np.where(heavy < 0, -1.0, 1.0), float(np.trace(covariance)))
    for d, (n, _, spread) in merged_in_a_tree(listed, _whitened(fits, components), _joint).items():
        live = fits[d].live(components)
        fits[d].identity_error = float(np.abs((spread / n - np.eye(len(spread)))[np.ix_(live, live)]).max(initial=0.0))
    return fits


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(id, component, n, deviation decimal(38,0), whitened, explained, identity_error) of each vector and component."""
    fits = fit(vectors, F.col(vector_column), components, scale)
    shared = vectors.sparkSession.sparkContext.broadcast(fits)
    kind = vectors.schema[id_column].dataType
    columns = [(id_column, kind), ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.DecimalType(38, 0))]
    columns += [(name, T.DoubleType()) for name in ("whitened", "explained", "identity_error")]
    schema = T.StructType([T.StructField(*c) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = {d: (f, f.projection(components), f.explained(components)) for d, f in shared.value.items()}
        for batch in batches:
            for d, at, rows in _whole(batch.column("v"), scale):
                one, projection, explained = told.get(d, (None, None, None))
                k, step = min(components, d), max(1, SLICE // d)
                for i in range(0, len(at), step):
                    deviation = one.deviations(rows[i : i + step])
                    white = deviation.astype(float) / one.n @ projection
                    places = np.repeat(np.arange(len(white)), k)
                    total = pa.array([Decimal(x) if x < 10**38 else None for x in squares(deviation)], pa.decimal128(38, 0))
                    out = [batch.column("id").take(pa.array(at[i : i + step][places])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(white))), pa.array(np.full(len(places), one.n))]
                    out += [total.take(pa.array(places)), pa.array(white.ravel()), pa.array(np.tile(explained, len(white))), pa.array(np.full(len(places), one.identity_error))]
                    yield pa.RecordBatch.from_arrays(out, names=schema.names)
        release()

    numbers = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    return vectors.select(F.col(id_column).alias("id"), numbers.alias("v")).where("v IS NOT NULL").mapInArrow(run, schema)
