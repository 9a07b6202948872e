"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

A fingerprint is a 64-bit majority vote over the XXH64 values of word shingles.  The join walks pairs
of trie nodes together.  A pair carries the bits in which its two prefixes differ and is dropped when
they exceed the budget.  The top of the trie is walked by Spark: a fingerprint is sent to the node
pairs of its own prefix within the budget, and pairs that are still too large go further down.  Each
remaining pair is one bounded group, walked bit by bit with numpy.  A group returns a spanning forest
of its links, never all links, and the forests are joined to components by star contraction.

Defined results: a null text counts as empty; a text without words has fingerprint zero and links like
any other; a very long text is read whole, its shingles in parts; repeated rows and equal ids each keep
their row; an id that is null keeps its row but can only name a component that has no other id (then
null); an empty table gives an empty result; further columns, whatever their names, are ignored by
``near_duplicates`` and kept as they are by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, map_slices, settle, text_bytes, text_keys

BITS = 64
#: Bits of the trie that the first step takes, and each further step for pairs that are too large.
TOP_BITS, STEP_BITS = 6, 4
#: Fingerprints in a pair of subtrees from which on Spark takes it further down.
LARGEST_PAIR = 200_000
SEED = 42
#: Keys of rows (28 bytes each) that are broadcast; more are joined by a shuffle.
MOST_BROADCAST_KEYS = 500_000


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The unsigned fingerprint of a text's ASCII-lower-cased word shingles; zero without words."""
    words = text.lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1]
    n, votes = len(starts), np.zeros(BITS, np.int64)
    starts, ends = starts.tolist(), (ends[shingle - 1 :] - 1).tolist()
    for at in range(0, n, 1 << 15):
        part = [digest(joined[s:e], SEED) for s, e in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)])]
        octets = np.array(part, "<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, keys: bool = False) -> DataFrame:
    """(doc_id long, fp long): the fingerprint's 64 bits as a signed long; ``keys`` adds the text's k1 and k2."""
    text = F.col(text_column)
    more = [c.alias(k) for k, c in text_keys(text).items()] if keys else []
    schema = "doc_id long, fp long" + (", k1 long, k2 int" if keys else "")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [fingerprint(x, shingle) for x in text_bytes(batch.column(1))]
        bits = np.array(values, np.uint64).view(np.int64)
        names = ["doc_id", "fp", *batch.schema.names[2:]]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.int64()), *batch.columns[2:]], names)

    return map_slices(docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"), *more), work, schema)


def _masks(bits: int, budget: int) -> list[int]:
    return [m for m in range(1 << bits) if m.bit_count() <= budget]


def _descend(pairs: DataFrame, depth: int, bits: int, budget: int) -> DataFrame:
    """Rows (fp, rep, other): own prefix and ``other`` are a node pair at ``depth``; one row for each child pair within the budget."""
    own = F.shiftrightunsigned("fp", BITS - depth - bits)
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(bits, budget)])
    low = own.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    below = pairs.withColumn("mask", F.explode(masks)).select(
        "fp", own.alias("own"), F.shiftleft("other", bits).bitwiseOR(low).bitwiseXOR(F.col("mask")).alias("other")
    )
    return below.where(F.bit_count(F.col("own").bitwiseXOR(F.col("other"))) <= budget)


def _merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Unite the classes of i and j; a label is the smallest index of its class."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = labels[labels]
            if (further == labels).all():
                break
            labels = further


def trie_classes(keys: np.ndarray, depth: int, budget: int, cut: int | None = None, leaf: int = 48, block: int = 1 << 19) -> np.ndarray:
    """Classes of sorted distinct uint64 keys linked at ``budget`` or fewer differing bits.

    ``cut``: keys before it are one subtree at ``depth`` and those from it another, and only links between
    the two count; None: all keys are one subtree.  Node pairs are index ranges of the sorted keys.
    """
    n = len(keys)
    labels = np.arange(n)
    if cut is None:
        start = np.array([[0, n, 0, n, 0]], np.int64)
    else:
        start = np.array([[0, cut, cut, n, 0]], np.int64)
        if cut in (0, n):
            return labels
        start[0, 4] = int(keys[0] >> np.uint64(BITS - depth) ^ keys[-1] >> np.uint64(BITS - depth)).bit_count() if depth else 0
    stack = [(depth, start)]
    while stack:
        level, pairs = stack.pop()
        if len(pairs) > block:
            half = len(pairs) // 2
            stack += [(level, pairs[:half]), (level, pairs[half:])]
            continue
        la, ra, lb, rb, err = pairs.T
        small = (ra - la) * (rb - lb) <= leaf
        if level == BITS:
            small[:] = True
        if small.any():
            sa, sb, wa, wb = la[small], lb[small], (ra - la)[small], (rb - lb)[small]
            each = wa * wb
            at = np.repeat(np.arange(len(each)), each)
            k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            i, j = sa[at] + k // wb[at], sb[at] + k % wb[at]
            near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            labels = _merge(labels, i[near], j[near])
        pairs = pairs[~small]
        if not len(pairs):
            continue
        la, ra, lb, rb, err = pairs.T
        zeros = np.concatenate(([0], np.cumsum((keys >> np.uint64(BITS - 1 - level) & np.uint64(1)) == 0)))
        ma, mb = la + zeros[ra] - zeros[la], lb + zeros[rb] - zeros[lb]
        same, cross = la == lb, la != lb
        below = [
            np.stack((la, ma, lb, mb, err), 1),
            np.stack((ma, ra, mb, rb, err), 1),
            np.stack((la, ma, mb, rb, err + 1), 1),
            np.stack((ma, ra, lb, mb, err + 1), 1)[cross],
        ]
        pairs = np.concatenate(below)
        pairs = pairs[(pairs[:, 4] <= budget) & (pairs[:, 1] > pairs[:, 0]) & (pairs[:, 3] > pairs[:, 2])]
        if len(pairs):
            stack.append((level + 1, pairs))
    return labels


def _forest(depth: int, budget: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(group["fp"].to_numpy(np.int64).view(np.uint64))
        cut = None
        if key[0] != key[1]:
            cut = int(np.searchsorted(keys >> np.uint64(BITS - depth), np.uint64(key[1])))
        labels = trie_classes(keys, depth, budget, cut)
        linked = labels != np.arange(len(keys))
        return pd.DataFrame({"u": keys[labels[linked]].view(np.int64), "v": keys[linked].view(np.int64)})

    return run


def links(fps: DataFrame, budget: int = 2, largest: int = LARGEST_PAIR) -> DataFrame:
    """Edges (u, v) between the distinct fingerprints ``fp`` whose closure is that of all links within the budget."""
    depth, found = TOP_BITS, None
    live = _descend(fps.select("fp", F.lit(0).cast("long").alias("other")), 0, depth, budget)
    while True:
        keyed = live.select("fp", "other", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        heavy = None
        if depth + STEP_BITS < BITS:
            heavy = keyed.groupBy("lo", "hi").count().where(F.col("count") > largest).select("lo", "hi")
            heavy = settle(heavy)
            heavy = None if heavy.isEmpty() else heavy
        light = keyed if heavy is None else keyed.join(heavy, ["lo", "hi"], "left_anti")
        edges = light.select("fp", "lo", "hi").groupBy("lo", "hi").applyInPandas(_forest(depth, budget), "u long, v long")
        found = edges if found is None else found.unionByName(edges)
        if heavy is None:
            return found
        deeper = settle(keyed.join(heavy, ["lo", "hi"], "left_semi").select("fp", "other"))  # else each level computes those above again
        live = _descend(deeper, depth, STEP_BITS, budget)
        depth += STEP_BITS


def star_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge; the root is the smallest node that it reaches.

    Alternates large and small stars.  Each round is settled, so lineage stays short and no round is lost
    with an executor.  Only two numbers of a round reach the driver.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    now = settle(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct())
    before = state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
        now = settle(small.unionByName(low.select(F.col("m").alias("u"), "v")).distinct())
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("v").alias("node"), F.col("u").alias("root"))


def near_duplicates(docs: DataFrame, budget: int = 2, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text", largest: int = LARGEST_PAIR) -> DataFrame:
    """(doc_id, fp, component_id) for each row: the smallest id reachable over links of ``budget`` or fewer bits."""
    marked = settle(with_fingerprints(docs, id_column, text_column, shingle))
    classes = _classes(marked, budget, largest)
    names = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    return marked.join(classes.join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _classes(marked: DataFrame, budget: int, largest: int = LARGEST_PAIR) -> DataFrame:
    """(fp, rep, root) for each fingerprint: its smallest id and the fingerprint that names its component."""
    fps = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = star_components(links(fps, budget, largest))
    return fps.join(roots, fps.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))


def keep_one(docs: DataFrame, budget: int = 2, shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` without near-duplicates, columns as they are: one row stays for each component.

    It is the row with the smallest doc_id (null last), among equal ids that of the smallest text hash, and
    among rows equal in both that of the smallest hash of all columns.  So a repeated id loses no text.
    """
    marked = settle(with_fingerprints(docs, "doc_id", "text", shingle, keys=True))
    return kept_rows(docs, marked.join(_classes(marked, budget).select("fp", F.col("root").alias("label")), "fp"))


def kept_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, given (doc_id, k1, k2, label) of each row; equal labels are a component.

    Texts are not shuffled while the rows that go have at most ``MOST_BROADCAST_KEYS`` keys.
    """
    key, one = ["doc_id", "k1", "k2"], F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k1", "k2")
    counted = settle(found.groupBy("label", *key).agg(F.count("*").alias("copies")))
    first = counted.groupBy("label").agg(F.min(one).alias("first")).select(F.col("label").alias("own"), "first")
    counted = settle(counted.join(first, F.col("label") == F.col("own")).select(*key, "copies", (one == F.col("first")).alias("stays")))
    stays, goes = counted.where("stays"), counted.where("not stays")
    rows = carried(docs, i=F.col("doc_id").cast("long"), **{f"r{k}": v for k, v in text_keys(F.col("text")).items()})
    same = F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("rk1") == F.col("k1")) & (F.col("rk2") == F.col("k2"))
    few = lambda df: F.broadcast(df) if df.count() <= MOST_BROADCAST_KEYS else df
    if goes.count() <= MOST_BROADCAST_KEYS:
        rows = rows.join(F.broadcast(goes.select(*key)), same, "left_anti")
    else:
        rows = rows.join(stays.select(*key), same, "left_semi")
    again = stays.where("copies > 1").select(*key)
    if again.isEmpty():
        return rows.select("row.*")
    again = few(again)
    hashed = [f"row.`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    alike = rows.join(again, same, "left_semi").groupBy("i", "rk1", "rk2").agg(F.min_by("row", F.xxhash64(*hashed)).alias("row"))
    return rows.join(again, same, "left_anti").select("row.*").unionByName(alike.select("row.*"))
