"""Batches for a model's requests: as many rows in order as a budget of tokens and a number of rows allow.

Where a batch ends decides where the next begins, so a sequence looks serial, and one firm, or the whole table, may be
one sequence.  It is not done in one task: rows get their place by a range partitioning, and a sequence is cut into
blocks of equal size.  A batch has at most ``size`` rows, so the first batch of a block begins in its first ``size``
places, and a block is a function from that place to the one in the next block: pointers to the next batch, doubled
until they leave the block.  The functions of blocks are joined by doubling too, a join on small arrays a round, and
then each block numbers its rows by itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

#: What an embedding request takes, as fixed values.
MOST_TOKENS, MOST_TEXTS, MOST_TEXT_TOKENS = 240_000, 512, 8_000
#: Rows of a block; at least four times the rows of a batch.
BLOCK = 65_536


def next_batches(tokens: np.ndarray, budget: int, size: int) -> np.ndarray:
    """For a batch that begins at each place, where the next one begins; a row beyond the budget is a batch by itself."""
    upto = np.concatenate(([0], np.cumsum(tokens)))
    at = np.arange(len(tokens))
    fits = np.searchsorted(upto, upto[:-1] + budget, side="right") - 1
    return np.maximum(at + 1, np.minimum(fits, at + size))


def leaps(tokens: np.ndarray, budget: int, size: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the first ``size`` places of a block: the place in the next block to which the batches that begin
    there lead, and their number in this block.  ``tokens`` are those of the block and of ``size`` rows after it."""
    to = next_batches(tokens, budget, size)[:block]
    n = len(to)
    count = np.ones(n, np.int64)
    while (inside := np.nonzero(to < n)[0]).size:
        count[inside], to[inside] = count[inside] + count[to[inside]], to[to[inside]]
    return to[:size] - n, count[:size]


def _placed(rows: DataFrame, keys: list[str], order: list[str], tokens: Column) -> DataFrame:
    """(row, own, key, n, place, t) as a written table: a number for each row and each key, the key's rows, and the row's
    place in the key's order, without one task for a key."""
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    narrow = rows.select(F.struct("*").alias("row"), key.alias("k"), F.struct(*order).alias("o"), F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(0)).cast("long").alias("t"))
    dealt = narrow.repartitionByRange("k", "o").sortWithinPartitions("k", "o")
    dealt = settle(dealt.select("row", "k", "t", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("own")))
    of_key = Window.partitionBy("k")
    pieces = dealt.groupBy("k", "part").agg(F.min("own").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select(F.col("k").alias("k_"), F.col("part").alias("part_"), F.min("first").over(of_key).alias("key"), F.sum("n").over(of_key).alias("n"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    joined = dealt.join(pieces, F.col("k").eqNullSafe(F.col("k_")) & (F.col("part") == F.col("part_")))
    return settle(joined.select("row", "own", "key", "n", (F.col("own") + F.col("shift")).alias("place"), "t"))


def _entries(functions: DataFrame) -> DataFrame:
    """(key, block, entry, first): where in each block its first batch begins, and that batch's number."""
    most, blocks = functions.agg(F.max("block")).first()[0], functions.select("key", "block")
    known = functions.where("block = 0").select("key", "block", F.lit(0).alias("entry"), F.lit(0).cast("long").alias("first"))
    step = 1
    while most is not None and step <= most:  # known below ``step``; ``functions`` leap over ``step`` blocks
        leap = F.get("leaps", F.col("entry"))
        further = known.join(functions, ["key", "block"]).select("key", (F.col("block") + step).alias("block"), leap["to"].alias("entry"), (F.col("first") + leap["n"]).alias("first"))
        known = settle(known.unionByName(further.join(blocks, ["key", "block"], "left_semi")))
        step *= 2
        if step <= most:
            later = functions.select("key", (F.col("block") - step // 2).alias("block"), F.col("leaps").alias("more"))
            joint = F.transform("leaps", lambda x: F.struct(F.get("more", x["to"])["to"].alias("to"), (x["n"] + F.get("more", x["to"])["n"]).alias("n")))
            functions = settle(functions.join(later, ["key", "block"]).select("key", "block", joint.alias("leaps")))
    return known


def token_batches(rows: DataFrame, keys: list[str], order: list[str], tokens: Column, budget: int = MOST_TOKENS, size: int = MOST_TEXTS, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``batch`` (long, from 0 for each key): taken in order, a row begins a new batch where its batch has
    ``size`` rows already or would hold more than ``budget`` tokens; so a row beyond the budget is a batch by itself.

    No keys: one sequence.  Null keys are a key, null or negative tokens count 0, rows equal in ``order`` may change
    places, an empty table stays empty; a column ``batch`` of ``rows`` is replaced.
    """
    block = max(block, 4 * size)
    placed = _placed(rows, keys, order, tokens)
    inside = placed.select("own", "key", "n", "t", F.expr(f"place div {block}").alias("block"), F.expr(f"cast(place % {block} as int)").alias("at"))
    after = inside.where(f"at < {size} AND block > 0").select("own", "key", "n", "t", (F.col("block") - 1).alias("block"), (F.col("at") + block).alias("at"))
    both = inside.unionByName(after)

    def leap(frame: pd.DataFrame) -> pd.DataFrame:
        to, n = leaps(frame.sort_values("at")["t"].to_numpy(), budget, size, block)
        return pd.DataFrame({"key": [frame["key"].iloc[0]], "block": [frame["block"].iloc[0]], "leaps": [[{"to": int(a), "n": int(b)} for a, b in zip(to, n)]]})

    long_ones = both.where(F.col("n") > block)  # the others have one block, which begins with a batch
    entries = _entries(settle(long_ones.groupBy("key", "block").applyInPandas(leap, "key long, block long, leaps array<struct<to: int, n: long>>")))

    def number(frame: pd.DataFrame) -> pd.DataFrame:
        """Blocks of some keys, each from its entry on."""
        frame = frame.iloc[np.lexsort((frame["at"], frame["block"], frame["key"]))]
        at, tokens_of, entry, first = (frame[c].to_numpy() for c in ("at", "t", "entry", "first"))
        batch, begins = np.empty(len(frame), np.int64), np.nonzero(at == 0)[0]
        for low, high in zip(begins, [*begins[1:], len(frame)]):
            to, starts, i = next_batches(tokens_of[low:high], budget, size).tolist(), np.zeros(high - low, np.int64), int(entry[low])
            while i < high - low:
                starts[i] = 1
                i = to[i]
            batch[low:high] = first[low] + np.cumsum(starts) - 1  # before the entry: the last batch of the block before
        mine = at < block
        return pd.DataFrame({"own": frame["own"].to_numpy()[mine], "batch": batch[mine]})

    slots = max(1, placed.count() // block)
    begun = both.join(entries, ["key", "block"], "left").withColumn("slot", F.pmod(F.xxhash64("key", "block"), F.lit(slots)))
    begun = begun.select("slot", "own", "key", "block", "at", "t", F.coalesce("entry", F.lit(0)).alias("entry"), F.coalesce("first", F.lit(0)).alias("first"))
    numbered = begun.groupBy("slot").applyInPandas(number, "own long, batch long")
    out = placed.select("own", "row").join(numbered, "own")
    return out.select(*[F.col("row")[c].alias(c) for c in rows.columns if c != "batch"], "batch")


def batch_sizes(batched: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """(keys, batch, n_rows, n_tokens) of rows with batches."""
    return batched.groupBy(*keys, "batch").agg(F.count("*").alias("n_rows"), F.sum(F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(0))).cast("long").alias("n_tokens"))
