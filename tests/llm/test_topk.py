import random

from pyspark.sql import functions as F

from tidemark.llm import topk


def slow(rows, k):
    import math

    sound = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(sound):  # each row that asks, against every other row
        if q % 20 == 0:
            scores = [(-sum(a * b for a, b in zip(v, w)), i) for j, (i, w) in enumerate(sound) if j != at and len(w) == len(v)]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def run(spark, rows, k=5, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as norm", "true as asks")
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k, **options).collect())


def test_exact_with_ties_and_unsound_vectors(spark, monkeypatch):
    rng = random.Random(2)
    vec = lambda n, s: [rng.choice([-1, 1]) * rng.randrange(0, 16) / 16 * s for _ in range(n)]
    rows = [(i, vec(6, rng.choice([1, 1, 0.1, 3]))) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(100)] + [(i, vec(3, 1)) for i in range(400, 430)]
    rows += [(500, None), (501, []), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (520, [float("nan")] * 6), (540, [float("inf")] * 6), (None, vec(6, 1)), (40, vec(6, 1)), (41, rows[41][1]), (560, [0.0] * 6)]
    want = slow(rows, 5)
    assert run(spark, rows) == want
    monkeypatch.setattr(topk, "FIRST_VECTORS", 10)
    assert run(spark, rows, query_block=64, range_rows=50) == want


def test_pruned_buckets_agree():
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(-64, 65, (1, 32))
    rows = np.concatenate((base + rng.integers(-9, 10, (400, 32)), rng.integers(-64, 65, (1500, 32)), rng.integers(-3, 4, (500, 32))))
    ids = rng.permutation(len(rows))
    queries = topk.Queries(ids[:50], rows[:50], 20)
    best, floor = topk.Best(50, 20), np.full(50, topk.NONE)
    order = np.argsort(-(rows * rows).sum(1), kind="stable")
    for i in range(0, len(order), 200):
        queries.bucket(best, floor, ids[order[i : i + 200]], rows[order[i : i + 200]])
    products = rows[:50] @ rows.T
    for q in range(50):
        want = sorted((-s, i) for s, i in zip(products[q], ids) if i != ids[q])[:20]
        assert [(-s, i) for s, i in zip(best.scores[q], best.ids[q])] == want


def test_large_components_and_empty(spark):
    rows = [(i, [float(i) * 1e6, 3.0]) for i in range(25)]
    assert run(spark, rows) == slow(rows, 5)
    assert run(spark, []) == []
