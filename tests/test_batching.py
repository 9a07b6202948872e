import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import batching as B


def serial(rows, budget, size):
    """One row after the other, as a request loop does it."""
    out, batch, n, used = {}, {}, {}, {}
    for key, place, tokens in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        t = max(tokens or 0, 0)
        if key not in batch:
            batch[key], n[key], used[key] = 0, 0, 0
        elif n[key] == size or used[key] + t > budget:
            batch[key], n[key], used[key] = batch[key] + 1, 0, 0
        n[key] += 1
        used[key] += t
        out[key, place] = batch[key]
    return out


def run(spark, rows, keys, budget, size, block):
    df = spark.createDataFrame(rows, "key string, place long, tokens int").selectExpr("*", "1 as k", "2 as own", "3 as batch", "'x' as t")
    got = B.token_batches(df.repartition(6), keys, ["place"], F.col("tokens"), budget, size, block)
    assert got.columns == ["key", "place", "tokens", "k", "own", "t", "batch"]
    return {(r.key, r.place): r.batch for r in got.collect()}


@pytest.mark.parametrize("budget, size, block", [(100, 7, 28), (1000, 5, 64)])
def test_as_one_after_the_other_with_a_hot_key(spark, budget, size, block):
    rng = random.Random(budget)
    rows = [("hot", i, rng.choice([0, 1, 9, 30, 60, 150, None, -4])) for i in range(300)]
    rows += [(f"k{i % 20}", i, rng.randrange(0, 70)) for i in range(150)] + [(None, i, 20) for i in range(40)]
    assert run(spark, rows, ["key"], budget, size, block) == serial(rows, budget, size)


def test_one_sequence_and_empty(spark):
    rows = [(f"k{i % 3}", i, (i * 37) % 50) for i in range(150)]
    want = {place: b for (_, place), b in serial([("", p, t) for _, p, t in rows], 120, 6).items()}
    assert {p: b for (_, p), b in run(spark, rows, [], 120, 6, 24).items()} == want
    assert run(spark, [], ["key"], 10, 2, 8) == {} and run(spark, [("a", 1, 99)], [], 10, 2, 8) == {("a", 1): 0}


@pytest.mark.parametrize("seed", range(20))
def test_leaps_follow_the_pointers(seed):
    rng = np.random.default_rng(seed)
    tokens, size, block = rng.integers(0, 40, 80), 8, 64
    to = B.next_batches(tokens, 100, size)
    ends, counts = B.leaps(tokens[: block + size], 100, size, block)
    for start in range(size):
        at, n = start, 0
        while at < block:
            at, n = int(to[at]), n + 1
        assert (ends[start], counts[start]) == (at - block, n)


def test_no_task_holds_the_hot_sequence(spark):
    """Half of the rows are of one key; no block is larger than its bound, whatever the key holds."""
    df = spark.range(4_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"), F.col("id").alias("place"))
    got = B.token_batches(df, ["key"], ["place"], F.lit(10), 70, 50, 500)
    hot = got.where("key = 'hot'").groupBy("batch").count().collect()
    assert len(hot) == -(-2_000 // 7) and max(r["count"] for r in hot) == 7
    assert got.where("key <> 'hot' and batch > 0").isEmpty() and got.count() == 4_000
