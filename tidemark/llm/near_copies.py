"""SimHash near copies by exact word-shingle similarity: candidates from the trie and banded minimum hashes, the rest by prefixes, each verified.

A text is the set of its ASCII-lower-cased five-word shingles; two texts are near copies where the Jaccard
similarity of their sets is at least ``LEAST``.  Texts with the same set are one node.  The first candidates
are the trie's (``simhash.links`` on the sets' fingerprints, ``BUDGET`` bits).  At a similarity of 0.8 two
fingerprints differ by ten of 64 bits on average, a budget at which the trie would walk nearly all node
pairs; so nodes that share a band of ``ROWS`` of their minimum hashes are candidates too: at 0.8 a pair shares
one of the ``BANDS`` bands with a probability of 0.9998.  Every member of a band's bucket is paired with the
smallest one.  Where links then leave more than one component in a bucket, as where texts share a long passage, its
members go into the buckets of ``FINE_BANDS`` bands of ``FINE_ROWS`` further minimum hashes, which tell 0.8 from less
more sharply (at 0.8 a pair shares one with 0.997, at 0.55 with 0.24), and every member is paired with two of its
bucket that a hash names, others in each band.  So these pairs grow with the members, never with their square.

These steps find most links, not all.  An exact one gives the rest: with every set in one order of all shingles, two
sets of a similarity of 0.8 share a shingle among the first fifth (and one) of each.  Nodes of different components that
share such a shingle, whose sizes, places and parities (``parities``) leave room for the similarity, and that no step
before has refused, are verified as well, so no link between components is missed.  Shingles that many texts hold come last in the order, so
few nodes share a place before them; the order is fitted on a part of the texts, which changes how many pairs are
compared, never which links are found.  A shingle of more than ``BLOCK`` nodes is compared in pairs of blocks, so no task
holds all of it; where very many texts that are no near copies consist of common passages, this step is quadratic in them.
Only pairs that exact similarity confirms are links; the tables of the steps are dropped when the groups are written.

Defined results: as in ``simhash``; a text of fewer than five words is one shingle, a text without words the
empty set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, settle, text_bytes, text_keys, without_steps
from .simhash import BITS, MOST_BROADCAST_KEYS, kept_rows, links, star_components

SHINGLE, LEAST = 5, (4, 5)  # similarity as a fraction, so that it is compared exactly
BANDS, ROWS = 16, 4
FINE_BANDS, FINE_ROWS = 32, 8
#: Every n-th text orders the shingles, all texts up to ``FIT_ALL``; those in ``COMMON`` of them or more come last, at most ``MOST_COMMON``.
FIT_EVERY, FIT_ALL, COMMON, MOST_COMMON = 8, 1 << 15, 3, 1 << 18
#: Nodes of a shingle that are compared at once.
BLOCK = 512
#: Differing bits that the trie walks.
BUDGET = 2
SEED = 42

_DRAWN = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS), np.uint64, endpoint=False)
_TIMES, _PLUS = _DRAWN[0] | np.uint64(1), _DRAWN[1]
_FINE_DRAWN = np.random.default_rng(SEED + 1).integers(0, 2**64, (2, FINE_BANDS * FINE_ROWS), np.uint64, endpoint=False)
_FINE_TIMES, _FINE_PLUS = _FINE_DRAWN[0] | np.uint64(1), _FINE_DRAWN[1]


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    words = text.lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist())], np.uint64))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The majority vote of a set's hashes, as a signed long."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.int64)[0])


def node_of(hashes: np.ndarray) -> int:
    return int(np.array([xxhash.xxh3_64_intdigest(hashes.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def _banded(hashes: np.ndarray, times: np.ndarray, plus: np.ndarray, rows: int) -> list[int]:
    """A signed long for each band of ``rows`` minimum hashes; none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(len(times), np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[at : at + 2048, None] * times + plus).min(0), out=least)
    bands = [xxhash.xxh3_64_intdigest(least[rows * b : rows * (b + 1)].tobytes(), b) for b in range(len(times) // rows)]
    return np.array(bands, np.uint64).view(np.int64).tolist()


def buckets(hashes: np.ndarray) -> list[int]:
    return _banded(hashes, _TIMES, _PLUS, ROWS)


def fine_buckets(hashes: np.ndarray) -> list[int]:
    return _banded(hashes, _FINE_TIMES, _FINE_PLUS, FINE_ROWS)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * common >= LEAST[0] * (len(a) + len(b) - common)


def prefix_of(hashes: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first shingles of a set, one of which every set that is similar has among its own first ones.

    Others come by their hashes, then those of the sorted ``common`` by their ranks.
    """
    n = len(hashes)
    most = n - -(-LEAST[0] * n // LEAST[1]) + 1 if n else 0
    if not len(common):
        return hashes[:most]
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    last = common[at] == hashes
    first = hashes[~last][:most]
    if len(first) == most:
        return first
    return np.concatenate((first, hashes[last][np.argsort(ranks[at[last]])[: most - len(first)]]))


def parities(hashes: np.ndarray) -> bytes:
    """A bit for each place, of at least twice as many as there are hashes: whether an odd number of them fall on it.

    Each bit in which two sets differ stands for at least one hash that is in one of them only.
    """
    places = max(64, 1 << (2 * len(hashes)).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1, bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """At least so many hashes are in one of the two sets only, by their ``parities``."""
    x, y = (np.frombuffer(p, np.uint64) for p in sorted((a, b), key=len))
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, ranks) of the shingles that come last: those of most texts, the most frequent at the end."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(x) for x in text_bytes(batch.column(0))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["token"])

    fit = docs.select("text")
    if docs.count() > FIT_ALL:
        fit = fit.where(F.pmod(F.xxhash64("text"), F.lit(FIT_EVERY)) == 0)
    held = map_slices(fit, work, "token long").groupBy("token").count().where(F.col("count") >= COMMON)
    found = held.orderBy(F.desc("count"), "token").limit(MOST_COMMON).toPandas()
    tokens = found["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], -order


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, node, n, fp, buckets, prefix, bits) for each row."""
    common, ranks = _common(docs)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(x) for x in text_bytes(batch.column(3))]
        made = [pa.array(map(f, sets), pa.int64()) for f in (node_of, len, fingerprint_of)]
        lists = map(buckets, sets), (prefix_of(s, common, ranks).view(np.int64) for s in sets)
        columns = [*batch.columns[:3], *made, *[pa.array(x, pa.list_(pa.int64())) for x in lists], pa.array(map(parities, sets), pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "k1", "k2", "node", "n", "fp", "buckets", "prefix", "bits"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(k) for k, c in text_keys(F.col("text")).items()], "text")
    return map_slices(chosen, work, "doc_id long, k1 long, k2 int, node long, n long, fp long, buckets array<long>, prefix array<long>, bits binary")


def _with_sets(docs: DataFrame) -> DataFrame:
    """(node, hashes) for each row: the set as bytes."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(x) for x in text_bytes(batch.column(0))]
        return pa.RecordBatch.from_arrays([pa.array(map(node_of, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "hashes"])

    return map_slices(docs.select("text"), work, "node long, hashes binary")


def _sets(docs: DataFrame, marked: DataFrame, members: DataFrame) -> DataFrame:
    """(node, hashes) once for each of the nodes; texts stay where they are while the nodes' text keys are few."""
    keys = settle(marked.join(members, "node", "left_semi").groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("key")).select("key.*"))
    hint = F.broadcast if keys.count() <= MOST_BROADCAST_KEYS else (lambda x: x)
    texts = docs.select("text", *[c.alias(k) for k, c in text_keys(F.col("text")).items()]).join(hint(keys), ["k1", "k2"], "left_semi")
    return settle(_with_sets(texts).dropDuplicates(["node"]))


def _verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes whose sets are similar."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (batch.column(i).to_pylist() for i in (2, 3))
        near = pa.array([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)], pa.bool_())
        return batch.select(["u", "v"]).filter(near)

    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u")
    both = both.join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v")
    return settle(map_slices(both.select("u", "v", "a", "b"), work, "u long, v long", rows=64))


def _candidates(found: DataFrame) -> DataFrame:
    """Distinct (u, v) of (u, n_u, v, n_v) that sizes allow to be similar."""
    fits = F.lit(LEAST[1]) * F.least("n_u", "n_v") >= F.lit(LEAST[0]) * F.greatest("n_u", "n_v")
    return settle(found.where("u <> v").where(fits).select("u", "v").distinct())


def _trie_pairs(nodes: DataFrame) -> DataFrame:
    """(u, n_u, v, n_v): a spanning forest of the nodes whose fingerprints are within the trie's budget."""
    sized = F.struct("node", "n")
    fps = settle(nodes.groupBy("fp").agg(F.min(sized).alias("first")))
    equal = nodes.join(fps, "fp").select(F.col("first.node").alias("u"), F.col("first.n").alias("n_u"), F.col("node").alias("v"), F.col("n").alias("n_v"))
    found = links(fps.select("fp"), BUDGET).select(F.col("u").alias("fp_u"), F.col("v").alias("fp_v"))
    a = fps.select(F.col("fp").alias("fp_u"), F.col("first.node").alias("u"), F.col("first.n").alias("n_u"))
    b = fps.select(F.col("fp").alias("fp_v"), F.col("first.node").alias("v"), F.col("first.n").alias("n_v"))
    return equal.unionByName(found.join(a, "fp_u").join(b, "fp_v").select("u", "n_u", "v", "n_v"))


def _mixed(placed: DataFrame, roots: DataFrame) -> DataFrame:
    """(v, n_v, root) of the members of buckets that hold more than one component."""
    rooted = placed.join(roots.withColumnRenamed("node", "v"), "v", "left").withColumn("root", F.coalesce("root", "v"))
    apart = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    return settle(rooted.join(apart, "bucket", "left_semi").select("v", "n_v", "root").distinct())


def _fine_pairs(sets: DataFrame, mixed: DataFrame) -> DataFrame:
    """(u, n_u, v, n_v): each member with two of its fine buckets, where their components differ."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [fine_buckets(np.frombuffer(x, np.uint64)) for x in batch.column(3).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.list_(pa.int64()))], ["v", "n_v", "root", "fine"])

    members = mixed.join(sets.select(F.col("node").alias("v"), "hashes"), "v").select("v", "n_v", "root", "hashes")
    placed = settle(map_slices(members, work, "v long, n_v long, root long, fine array<long>"))
    placed = placed.select("v", "n_v", "root", F.explode("fine").alias("fine"))
    drawn = F.struct(F.xxhash64("fine", "v").alias("drawn"), "v", "n_v", "root")
    ends = placed.groupBy("fine").agg(F.min(drawn).alias("first"), F.max(drawn).alias("last"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    met = placed.join(ends, "fine")
    sides = [met.where(F.col(f"{e}.root") != F.col("root")).select(F.least(f"{e}.v", "v").alias("u"), F.col(f"{e}.n_v").alias("n_u"), F.greatest(f"{e}.v", "v").alias("v"), "n_v") for e in ("first", "last")]
    return sides[0].unionByName(sides[1])


def _prefix_pairs(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(u, v) of all nodes of different components that can be similar, by a shingle that both have among their first."""
    rooted = nodes.join(roots, "node", "left").select(F.col("node").alias("v"), "n", F.coalesce("root", "node").alias("root"), F.posexplode("prefix").alias("at", "token"))
    held = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size"))
    shared = settle(held.where("lo <> hi").select("token", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    hint = F.broadcast if shared.count() <= MOST_BROADCAST_KEYS else (lambda x: x)
    dealt = rooted.join(hint(shared), "token").withColumn("block", F.pmod(F.xxhash64("v", "token"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = settle(dealt.select("token", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "v", "n", "root", "at"))
    a, b = (dealt.select("token", "x", "y", *[F.col(c).alias(f"{c}_{side}") for c in ("block", "v", "n", "root", "at")]) for side in "ab")
    room = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))  # no more can be in common from here on
    fits = [
        F.col("v_a") < F.col("v_b"),
        F.col("root_a") != F.col("root_b"),
        (F.col("x") == F.col("y")) | (F.col("block_a") != F.col("block_b")),
        F.lit(sum(LEAST)) * room >= F.lit(LEAST[0]) * (F.col("n_a") + F.col("n_b")),
    ]
    met = a.join(b, ["token", "x", "y"]).where(fits[0] & fits[1] & fits[2] & fits[3])
    return settle(met.select(F.col("v_a").alias("u"), F.col("v_b").alias("v")).distinct())


def _near_by_parities(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes that can be similar by their parities."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, a, b = (batch.column(i).to_pylist() for i in (2, 3, 4))
        near = [sum(LEAST) * apart(x, y) <= (LEAST[1] - LEAST[0]) * m for m, x, y in zip(n, a, b)]
        return batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    both = pairs.join(nodes.select(F.col("node").alias("u"), F.col("n").alias("n_u"), F.col("bits").alias("a")), "u")
    both = both.join(nodes.select(F.col("node").alias("v"), F.col("n").alias("n_v"), F.col("bits").alias("b")), "v")
    return settle(map_slices(both.select("u", "v", (F.col("n_u") + F.col("n_v")).alias("n"), "a", "b"), work, "u long, v long", rows=1024))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def _joined(roots: DataFrame, fresh: DataFrame) -> DataFrame:
    """The roots after further links; components so far stand for the links that made them."""
    return roots if fresh.isEmpty() else star_components(roots.select(F.col("root").alias("u"), F.col("node").alias("v")).unionByName(fresh))


def _components(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """(node, label) for each node of the marked texts of ``docs``."""
    nodes = settle(marked.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "fp", "buckets", "prefix", "bits")]))
    placed = nodes.select(F.explode("buckets").alias("bucket"), F.col("node").alias("v"), F.col("n").alias("n_v"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("v", "n_v")).alias("first")).where("size > 1")
    placed = settle(placed.join(shared, "bucket"))
    stars = placed.select(F.col("first.v").alias("u"), F.col("first.n_v").alias("n_u"), "v", "n_v")
    pairs = _candidates(stars.unionByName(_trie_pairs(nodes)))
    members = placed.select(F.col("v").alias("node")).unionByName(pairs.select(F.col("u").alias("node"))).unionByName(pairs.select(F.col("v").alias("node")))
    sets = _sets(docs, marked, settle(members.distinct()))
    edges = _verified(sets, pairs)
    roots = star_components(edges)
    mixed = _mixed(placed.where("size > 2").select("bucket", "v", "n_v"), roots)
    if not mixed.isEmpty():
        fine = settle(_candidates(_fine_pairs(sets, mixed)).join(pairs, ["u", "v"], "left_anti"))
        roots = _joined(roots, _verified(sets, fine))
        pairs = pairs.unionByName(fine)
    rest = _near_by_parities(nodes, _prefix_pairs(nodes, roots).join(_ordered(pairs), ["u", "v"], "left_anti"))
    if not rest.isEmpty():
        members = rest.select(F.col("u").alias("node")).unionByName(rest.select(F.col("v").alias("node")))
        roots = _joined(roots, _verified(_sets(docs, marked, settle(members.distinct())), rest))
    return nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("label"))


def _labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, label) for each row; equal labels are a component."""

    def make() -> DataFrame:
        marked = settle(_marked(docs))
        return marked.join(_components(docs, marked), "node").select("doc_id", "k1", "k2", "label")

    return without_steps(make)


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for each row: the smallest id reachable over links."""
    found = _labelled(docs)
    names = found.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return found.join(names, "label").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies, by the rules of ``simhash.keep_one``."""
    return kept_rows(docs, _labelled(docs))
