"""How far the sources of a language part in their words, by mergeable radix tries.

A partition counts the terms of its documents in one trie of bytes a language; a leaf has a counter of occurrences for
each source and one of documents, and the root, the empty term, counts every document.  The words of a slice of texts
are counted first and go into the trie in order, each from where it parts from the one before.  Tries that have grown to ``MOST_COUNTERS`` counters are handed on and begun anew, so
a task's memory is bounded.  The leaves go to ranges of
(language, term) with splitters drawn from them, and each range merges its tries; a walk in the order of UTF-8 bytes
gives the merged leaves, of which those in enough documents of the language are kept, as a written table.

With the totals of each group, a second walk over the kept leaves, in blocks, adds up the pairs of sources and keeps
each group's best candidates in order of value and bytes.  Pairs are done for blocks of sources, so a task's sums are
bounded whatever the number of sources; what is broadcast are the totals of the blocks of one job.

Words of a hot source, or a hot word, are counted where they are, and meet as one counter a task.

Defined results: null texts, languages and sources are ''; a group without terms has its rows (p by the smoothing
alone; values 0 where its language keeps no term); repeated rows count each; equal values are ordered by the item's
UTF-8 bytes; an empty table gives no rows; further columns are ignored; texts are counted whole, a slice of documents
at a time.  Counts are exact; p is as long as count sums of a language are below 2^59.
"""

from __future__ import annotations

import gc
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, settle, text_bytes

LEAST_DOCUMENTS = 30
SMOOTHING = 5
PARTS = 1_000_000_000
RANKS = 50
MOST_COUNTERS = 800_000
#: Words that are counted before they go into the trie.
WORDS = 2_000_000
#: Counters of a range; one partition each.
RANGE_COUNTERS = 150_000
#: Sources of a block, sums of pairs in one job, and leaves that are walked at once.
BLOCK_SOURCES, JOB_SUMS, LEAVES = 512, 4_000_000, 2048

#: Bytes of terms, A-Z lower-cased; all others as blanks.
TERM_BYTES = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

COUNTED = "lang string, term string, docs long, sources array<string>, counts array<long>"


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def shared_bytes(words: pa.Array) -> np.ndarray:
    """How many first bytes each of some sorted binary values shares with the one before."""
    ends = np.frombuffer(words.buffers()[1], np.int64 if pa.types.is_large_binary(words.type) else np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    sizes, out = np.diff(ends), np.zeros(len(words), np.int64)
    live, depth = np.arange(1, len(words)), 0
    while len(live):
        live = live[(sizes[live] > depth) & (sizes[live - 1] > depth)]
        live = live[data[ends[live] + depth] == data[ends[live - 1] + depth]]
        depth += 1
        out[live] = depth
    return out


class Trie:
    """A radix trie of bytes with counters at its leaves: occurrences in each source, and documents.

    A node is [label, children by first byte, number of its leaf].  Counters are arrays of (leaf, source, count) that
    are added up as they grow.
    """

    def __init__(self):
        self.root, self.leaves = [b"", None, None], 0
        self.parts: list[np.ndarray] = []
        self.docs = np.zeros(0, np.int64)

    def places(self, terms: list[bytes], shared: list[int]) -> np.ndarray:
        """The leaves of sorted terms, made where there are none; each walk begins where it parts from the last one."""
        out, path = [], [(self.root, 0)]
        for term, same in zip(terms, shared):
            while path[-1][1] > same:
                path.pop()
            (node, at), end = path[-1], len(term)
            while at < end:
                children = node[1]
                if children is None:
                    children = node[1] = {}
                below = children.get(term[at])
                if below is None:
                    below = children[term[at]] = [term[at:], None, None]
                elif not term.startswith(below[0], at):  # part the edge where they differ
                    label, alike, most = below[0], 1, min(end - at, len(below[0]))
                    while alike < most and term[at + alike] == label[alike]:
                        alike += 1
                    below[0] = label[alike:]
                    below = children[term[at]] = [label[:alike], {label[alike]: below}, None]
                node, at = below, at + len(below[0])
                path.append((node, at))
            if node[2] is None:
                node[2] = self.leaves
                self.leaves += 1
            out.append(node[2])
        return np.array(out, np.int64)

    def add(self, words: pa.Array, at: np.ndarray, sources: np.ndarray, counts: np.ndarray, docs: np.ndarray) -> None:
        """Take in counters: ``words`` (once each) has those at ``at``; ``docs`` are the documents of each of the words."""
        order = pc.sort_indices(words)
        ordered = words.take(order)
        leaves = np.empty(len(words), np.int64)
        leaves[order.to_numpy()] = self.places(ordered.to_pylist(), shared_bytes(ordered).tolist())
        self.docs = np.concatenate((self.docs, np.zeros(self.leaves - len(self.docs), np.int64)))
        self.docs[leaves] += docs
        self.parts = [_added(np.concatenate([*self.parts, np.stack((leaves[at], sources, counts))], axis=1))]

    @property
    def counters(self) -> int:
        return sum(part.shape[1] for part in self.parts)

    def walk(self) -> Iterator[tuple[bytes, int]]:
        """(term, leaf) in the order of bytes."""
        todo = [(b"", self.root)]
        while todo:
            before, (label, children, leaf) = todo.pop()
            term = before + label
            if leaf is not None:
                yield term, leaf
            if children:
                todo.extend([(term, children[first]) for first in sorted(children, reverse=True)])


def _added(part: np.ndarray) -> np.ndarray:
    """(leaf, source, count) with each leaf and source once, in order."""
    order = np.lexsort((part[1], part[0]))
    leaf, source, count = part[:, order]
    first = np.nonzero(np.concatenate(([True], (leaf[1:] != leaf[:-1]) | (source[1:] != source[:-1]))))[0] if len(leaf) else np.zeros(0, np.int64)
    return np.stack((leaf[first], source[first], np.add.reduceat(count, first) if len(first) else count))


class Names:
    """Numbers of sources, in the order that they come."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, column: pa.Array) -> np.ndarray:
        coded = column.dictionary_encode()
        numbers = np.array([self.known.setdefault(n, len(self.known)) for n in coded.dictionary.to_pylist()], np.int64)
        return numbers[coded.indices.to_numpy(zero_copy_only=False)]


def _leaves(tries: dict[str, Trie], names: Names, least: int = 0) -> Iterator[pa.RecordBatch]:
    """The leaves of tries in ``least`` documents, and all roots, as rows in order."""
    listed = pa.array(list(names.known), pa.string())
    for lang, trie in sorted(tries.items()):
        leaf, source, count = trie.parts[0]
        starts = np.searchsorted(leaf, np.arange(trie.leaves + 1))
        walked = ((t, i) for t, i in trie.walk() if trie.docs[i] >= least or not t)
        while some := [x for _, x in zip(range(16_384), walked)]:
            ids = np.array([i for _, i in some])
            sizes = starts[ids + 1] - starts[ids]
            ends = np.concatenate(([0], np.cumsum(sizes)))
            at = np.repeat(starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])
            lists = [listed.take(pa.array(source[at])), pa.array(count[at])]
            columns = {"lang": pa.array([lang] * len(some), pa.string()), "term": pa.array([t for t, _ in some], pa.binary()).cast(pa.string()), "docs": pa.array(trie.docs[ids])}
            yield pa.RecordBatch.from_pydict(columns | {n: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), x) for n, x in zip(("sources", "counts"), lists)})


@contextmanager
def _no_collector() -> Iterator[None]:
    """Tries hold no cycles, and walking millions of their nodes again and again costs more than building them."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()
        release()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tries: dict[str, Trie] = defaultdict(Trie)
    names = Names()
    found: dict[str, tuple[list, list, list]] = defaultdict(lambda: ([], [], []))

    def fold() -> None:
        """Count the words of each language and source, and the documents of each word."""
        for lang, (words, sizes, sources) in found.items():
            coded = pa.array(words, pa.binary()).dictionary_encode()
            v, word = len(coded.dictionary), coded.indices.to_numpy().astype(np.int64)
            pairs, counts = np.unique(np.repeat(np.array(sources, np.int64), sizes) * v + word, return_counts=True)
            once = np.unique(np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) * v + word)
            tries[lang].add(coded.dictionary, pairs % v, pairs // v, counts, np.bincount(once % v, minlength=v))
        found.clear()

    held = 0
    with _no_collector():
        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), names.of(batch.column("source")).tolist()
            for at in range(0, batch.num_rows, 256):
                for i, text in enumerate(text_bytes(batch.column("text").slice(at, 256)), at):
                    listed = terms(text)
                    listed.append(b"")  # the document itself
                    words, sizes, of = found[langs[i]]
                    words += listed
                    sizes.append(len(listed))
                    of.append(sources[i])
                    held += len(listed)
                if held >= WORDS:
                    fold()
                    held = 0
                    if sum(t.counters for t in tries.values()) >= MOST_COUNTERS:
                        yield from _leaves(tries, names)
                        tries.clear()
        fold()
        yield from _leaves(tries, names)


def _merge(least: int):
    """The tries of a range together; leaves in ``least`` documents of the language, and all roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, Trie] = defaultdict(Trie)
        names = Names()
        with _no_collector():
            for batch in batches:
                for lang in batch.column("lang").unique().to_pylist():
                    part = batch.filter(pc.equal(batch.column("lang"), lang))
                    coded = part.column("term").cast(pa.binary()).dictionary_encode()
                    v, word = len(coded.dictionary), coded.indices.to_numpy().astype(np.int64)
                    docs = np.zeros(v, np.int64)
                    np.add.at(docs, word, part.column("docs").to_numpy())
                    sizes = part.column("sources").value_lengths().to_numpy(zero_copy_only=False)
                    sources, counts = names.of(part.column("sources").flatten()), part.column("counts").flatten().to_numpy()
                    tries[lang].add(coded.dictionary, np.repeat(word, sizes), sources, counts, docs)
            yield from _leaves(tries, names, least)

    return run


def kept_leaves(docs: DataFrame, text: Column, lang: Column, source: Column, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, docs, sources, counts) of each kept term, and of the empty term, whose counts are documents; written."""
    plain = docs.select(*[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in (("text", text), ("lang", lang), ("source", source))])
    counted = settle(plain.mapInArrow(_count, COUNTED))
    counters = counted.agg(F.sum(F.size("sources"))).first()[0] or 0
    ranged = counted.repartitionByRange(max(1, -(-counters // RANGE_COUNTERS)), "lang", "term")
    return settle(ranged.mapInArrow(_merge(least), COUNTED))


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(PARTS * (count + 5) / whole), exact: long division by tens."""
    quotient, rest = np.divmod(counts + SMOOTHING, whole)
    for _ in range(len(str(PARTS)) - 1):
        more, rest = np.divmod(rest * 10, whole)
        quotient = quotient * 10 + more
    return quotient + 1


class Block:
    """The sums of one block of sources against another of the same language, and the candidates where they are one."""

    def __init__(self, left: list[tuple[str, int]], right: list[tuple[str, int]], same: bool, whole: int):
        self.left, self.right, self.same, self.whole = left, right, same, whole
        self.sums = np.zeros((len(left), len(right)), np.int64)
        self.best: list[list[tuple[int, bytes]]] = [[] for _ in left]

    def add(self, leaves: list[tuple], ranks: int) -> None:
        """Walk some leaves (term, sources, counts) in the order of bytes."""
        totals = np.array([sum(leaf[2]) for leaf in leaves], np.int64)
        sides = []
        for side in (self.left, self.right)[: 1 if self.same else 2]:
            place = {s: i for i, (s, _) in enumerate(side)}
            counts = np.zeros((len(side), len(leaves)), np.int64)
            for j, leaf in enumerate(leaves):
                for s, c in zip(leaf[1], leaf[2]):
                    if s in place:
                        counts[place[s], j] = c
            sides.append((counts, shares(counts, np.array([w for _, w in side], np.int64)[:, None])))
        (counts, ours), theirs = sides[0], sides[-1][1]
        for i in range(len(ours)):
            self.sums[i] += np.abs(theirs - ours[i]).sum(1)
        if self.same:
            apart = np.where(counts > 0, ours - shares(totals, np.int64(self.whole)), 0)
            for i, row in enumerate(apart):
                held = self.best[i]
                least = held[-1][0] if len(held) == ranks else 1
                new = [(-int(row[j]), leaves[j][0]) for j in np.nonzero(row >= -least if len(held) == ranks else row >= 1)[0]]
                self.best[i] = sorted(held + new)[:ranks] if new else held


def _walk(sent, ranks: int):
    """Pairs (lang, source, item, value) as part 'pair', once each, and candidates as part 'term', of a task's leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, list[Block]] = defaultdict(list)
        for lang, left, right, same, whole in sent.value:
            blocks[lang].append(Block(left, right, same, whole))
        for batch in batches:
            for at in range(0, batch.num_rows, LEAVES):
                part = batch.slice(at, LEAVES)
                rows = zip(*(part.column(c).to_pylist() for c in ("lang", "term", "sources", "counts")))
                for lang, leaves in groupby(rows, key=lambda r: r[0]):
                    some = [(t.encode(), s, c) for _, t, s, c in leaves]
                    for block in blocks.get(lang, ()):
                        block.add(some, ranks)
        for lang, found in blocks.items():
            for block in found:
                rows = [(lang, a, "pair", b, int(v)) for (a, _), line in zip(block.left, block.sums) for (b, _), v in zip(block.right, line) if v and a != b]
                rows += [(lang, s, "term", t.decode(), -v) for (s, _), best in zip(block.left, block.best) for v, t in best]
                for i in range(0, len(rows), 16_384):
                    columns = [pa.array(c, pa.int64() if j == 4 else pa.string()) for j, c in enumerate(zip(*rows[i : i + 16_384]))]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "part", "item", "value"])
        release()

    return run


def _jobs(groups: list[tuple[str, str, int, int]], whole: dict[str, int]) -> Iterator[list[tuple]]:
    """Blocks of sources that meet, for each job: (lang, left, right, the same block?, whole of the language)."""
    job, sums = [], 0
    for lang, rows in groupby(groups, key=lambda g: g[0]):
        sources = [(s, w) for _, s, w in rows]
        cut = [sources[i : i + BLOCK_SOURCES] for i in range(0, len(sources), BLOCK_SOURCES)]
        for i, left in enumerate(cut):
            for right in cut[i:]:
                cost = len(left) * len(right) + 100
                if job and sums + cost > JOB_SUMS:
                    yield job
                    job, sums = [], 0
                job.append((lang, left, right, left is right, whole[lang]))
                sums += cost
    if job:
        yield job


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): each source's distance to the others of its language ('pair', all of
    them), and the terms it uses more than its language does ('term', the first ``ranks``)."""
    spark = docs.sparkSession
    leaves = kept_leaves(docs, F.col(text), F.col(lang), F.col(source), least)
    terms_of = leaves.where("term <> ''")
    roots = leaves.where("term = ''").select("lang", F.explode("sources").alias("source"))
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    kept = terms_of.groupBy("lang").agg(F.count("*").alias("v"), F.sum(total).alias("n"))
    counts = terms_of.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("n"))
    # one row a group: they pair with each other in the result, so the result is far larger than they are
    groups = settle(roots.join(counts, ["lang", "source"], "left").join(kept.select("lang", "v", F.col("n").alias("all")), "lang", "left").na.fill(0))
    listed = groups.where("v > 0").orderBy("lang", "source")
    whole = {r[0]: r[1] for r in listed.groupBy("lang").agg(F.max(F.col("all") + SMOOTHING * F.col("v"))).toLocalIterator()}
    told = ((r.lang, r.source, r.n + SMOOTHING * r.v) for r in listed.toLocalIterator())
    parts = spark.createDataFrame([], "lang string, source string, part string, item string, value long")
    for job in _jobs(told, whole):
        shared = spark.sparkContext.broadcast(job)
        parts = parts.unionByName(terms_of.mapInArrow(_walk(shared, ranks), parts.schema))
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # a job walks two blocks once, so one side is missing where they differ; pairs of one block come from both sides
    both = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).groupBy("lang", "source", "item").agg(F.max("value").alias("value"))
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    full = others.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    ranked = full.unionByName(parts.where("part = 'term'"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return ranked.withColumn("rank", place).where((F.col("part") == "pair") | (F.col("rank") <= ranks))


#: The rows of op13 in DuckDB SQL.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS own, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT own, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT own) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
ln AS (SELECT lang, sum(n) AS n FROM gn GROUP BY lang),
p AS (SELECT lang, gn.source, term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (gn.n + 5 * v.v)::HUGEINT AS p
  FROM gn JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(p.n) + 5)) // (any_value(ln.n) + 5 * any_value(v.v))::HUGEINT AS q FROM p JOIN ln USING (lang) JOIN v USING (lang) GROUP BY lang, term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r QUALIFY part = 'pair' OR rank <= 50
"""
