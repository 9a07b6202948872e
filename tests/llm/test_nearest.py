import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import nearest


def slow(rows, k):
    """Each row that asks against every other row."""
    sound = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for at, (q, v) in enumerate(sound):
        if q % 20 == 0:
            scores = [(-math.fsum(a * b for a, b in zip(v, w)), i) for j, (i, w) in enumerate(sound) if j != at and len(w) == len(v)]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def run(spark, rows, k=5, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as own", "true as code", "2 as dim")
    return sorted(tuple(r) for r in nearest.nearest(df, F.col("vec_id") % 20 == 0, k, **options).collect())


def test_ties_copies_and_unsound_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vec = lambda n, s=1.0: (rng.integers(-16, 17, n) / 16 * s).tolist()
    rows = [(i, vec(6, s)) for i, s in zip(range(300), np.tile([1, 1, 0.125, 3], 75).tolist())]
    rows += [(300 + i, rows[7][1]) for i in range(100)] + [(i, vec(3)) for i in range(400, 430)]
    rows += [(500, None), (501, []), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (520, [float("nan")] * 6), (540, [float("inf")] * 6), (None, vec(6)), (40, vec(6)), (41, rows[41][1]), (560, [0.0] * 6)]
    monkeypatch.setattr(nearest, "ERRORS", 100.0)  # no vector is passed over, so the search is exact
    want = slow(rows, 5)
    assert run(spark, rows) == want
    monkeypatch.setattr(nearest, "BUCKET", 50)
    assert run(spark, rows, query_block=64) == want
    assert run(spark, rows[:3]) == slow(rows[:3], 5) and len(run(spark, rows[:3])) == 2
    assert run(spark, []) == [] and run(spark, [(20, None)]) == []


def model(seed, n, d, groups, shift):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    return (centres[rng.integers(0, groups, n)] + 0.5 * rng.normal(size=(n, d)) + shift).astype(np.float32).astype(float)


@pytest.mark.parametrize("groups, shift, d", [(1, 0, 64), (30, 0, 64), (10, 3, 96), (5, 0, 700)])
def test_recall_and_work(groups, shift, d):
    """Against brute force, for vectors without groups, with groups, off centre, and of many dimensions."""
    rows = model(groups, 6000, d, groups, shift)
    rows[5000:] = rows[77] if groups == 30 else rows[5000:]  # a hot vector
    ids, mean = np.arange(len(rows)), rows.mean(0)
    queries, best = nearest.Queries(ids[::20], rows[::20], mean), nearest.Best(300, 20)
    codes = nearest.Codes.of(rows, mean)
    reranked = sum(nearest.meet(queries, best, ids[i : i + 1500], ids[i : i + 1500], rows[i : i + 1500], codes.take(slice(i, i + 1500))) for i in range(0, 6000, 1500))
    hits = 0
    for q, own in enumerate(ids[::20]):
        scores = nearest.exact(rows[own][None, :], rows)
        scores[own] = -np.inf
        want = np.lexsort((ids, -scores))[:20]
        hits += len(set(want) & set(best.ids[q]))
        assert best.scores[q].tolist() == scores[best.ids[q]].tolist()
    assert hits / 6000 >= 0.98
    assert reranked < 0.4 * 300 * 6000


def test_estimates_stay_within_their_bounds():
    rows = model(9, 3000, 64, 4, 1)
    queries, codes = nearest.Queries(np.arange(50), rows[:50], rows.mean(0)), nearest.Codes.of(rows, rows.mean(0))
    estimate, bound = queries.estimates(slice(0, 50), codes)
    apart = np.abs(estimate - rows[:50] @ rows.T)
    assert (apart <= bound).mean() > 0.995 and np.median(apart / bound) > 0.1


def test_rotation_keeps_products():
    rows = np.random.default_rng(5).normal(size=(40, 100))
    turned = nearest.rotated(rows)
    assert turned.shape == (40, 256) and np.allclose(turned @ turned.T, rows @ rows.T)


def test_query_finds_the_nearest(spark):
    from tidemark.llm.queries import QUERIES

    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    want = slow([(r.vec_id, r.embedding) for r in table], 20)
    got = sorted(tuple(r) for r in QUERIES["op12_nearest"](spark, "/root/testdata/sf0.1").collect())
    assert len(got) == len(want) == 2000
    assert len({r[::2] for r in got} & {r[::2] for r in want}) >= 0.98 * len(want)
    exact = {r[::2]: r[3] for r in want}
    assert max(abs(r[3] - exact[r[::2]]) for r in got if r[::2] in exact) < 1e-12
