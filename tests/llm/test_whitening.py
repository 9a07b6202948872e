import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import whitening


def rows_of(spark, rows, kind="float", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 as n", "2 as component", "3 as id")
    return whitening.whiten(df, **options).collect()


def slow(rows, components=16):
    """By definition, in one array of doubles and Python's whole numbers."""
    sound = [(i, [math.floor(64 * x) + 1000000 for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    listed = sorted({tuple(x) for _, x in sound})
    n, sums = len(listed), [sum(c) for c in zip(*listed)]
    centred = np.array([[(n * x - s) / n for x, s in zip(v, sums)] for v in listed])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = []
    for i, v in sound:
        apart = [n * x - s for x, s in zip(v, sums)]
        white = np.array(apart) / n @ vectors / np.sqrt(np.maximum(values, 1e-300))
        out += [(i, c + 1, n, sum(a * a for a in apart), white[c], values[c] / np.trace(centred.T @ centred / n)) for c in range(len(values))]
    return out


def vectors(n, d, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * np.linspace(0.2, 2, d) @ np.linalg.qr(rng.normal(size=(d, d)))[0]).astype(np.float32).tolist()


def test_as_by_definition_with_copies_and_unsound_vectors(spark):
    rows = list(enumerate(vectors(300, 20)))
    rows += [(300 + i, rows[5][1]) for i in range(150)] + [(None, rows[6][1]), (7, rows[7][1]), (7, rows[7][1])]
    rows += [(900, None), (901, [None] * 20), (902, [float("nan")] * 20), (903, [1.0] * 19 + [float("-inf")]), (904, [])]
    got, want = rows_of(spark, rows), slow([r for r in rows if r[1] != []])
    key = lambda r: (-1 if r[0] is None else r[0], r[1], round(abs(r[4]), 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want] and len(got) == 453 * 16
    signs = {c: np.sign(sum(g[4] * w[4] for g, w in zip(got, want) if g[1] == c)) for c in range(1, 17)}
    assert max(abs(g[4] * signs[g[1]] - w[4]) for g, w in zip(got, want)) < 1e-9
    assert max(abs(g[5] / w[5] - 1) for g, w in zip(got, want)) < 1e-9
    assert len({g[6] for g in got}) == 1 and 0 <= got[0][6] < 1e-9


def test_lengths_without_variance_and_large_numbers(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0] * 3), (4, [2.0] * 3), (5, [4e15, 1.0, 0.0]), (6, [1e300] * 3)]
    got = {(r.vec_id, r.component): r for r in rows_of(spark, rows, "double")}
    assert set(got) == {(i, c) for i in (1, 2) for c in (1, 2)} | {(i, c) for i in (3, 4, 5) for c in (1, 2, 3)}
    assert all((r.whitened, r.explained, r.deviation, r.n, r.identity_error) == (0, 0, 0, 1, 0) for (i, _), r in got.items() if i < 3)
    want = {r[:2]: r for r in slow(rows[2:5])}
    assert all(got[k].deviation == want[k][3] and got[k].n == 3 for k in want)
    assert rows_of(spark, []) == [] and rows_of(spark, [(1, None)]) == []


def test_exact_squares():
    rng = np.random.default_rng(2)
    for top in (1 << 20, 1 << 45, 1 << 61):
        rows = rng.integers(-top, top, (20, 9))
        assert whitening.squares(rows) == [sum(int(x) ** 2 for x in r) for r in rows]
    n, sums = 10**11, [3 * 10**18, -(10**17)]
    assert whitening.deviations(np.array([[5, 1 << 40]]), n, sums).tolist() == [[5 * n - sums[0], (n << 40) - sums[1]]]


def test_too_many_dimensions(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MOST_DIMENSIONS", 2)
    with pytest.raises(ValueError, match="3 dimensions"):
        rows_of(spark, [(1, [1.0] * 3), (2, [2.0] * 3)])


def test_query(spark):
    from tidemark.llm.queries import QUERIES

    got = QUERIES["op11_whitening"](spark, "/root/testdata/sf0.01")
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    assert got.agg(F.count("*"), F.max("identity_error") < 1e-9, F.max(F.abs("whitened")) < 10).first()[:] == (500 * 16, True, True)
