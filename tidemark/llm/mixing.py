"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them).  A pattern offers its
tokens up to ``repeats`` times; the k-th repetition costs more than the one before (2k-1), so the flow
prefers fresh tokens and spreads repetition.  Sources demand their quota.  The flow through a pattern
says how many whole repetitions all its documents get and how many tokens one further, seeded, selection
must add, and how many of its tokens each source gets (``mix_routes``).  The selection takes documents by a
seeded hash of id and text up to the wanted number of tokens.  Its exact cut comes from a histogram of the
hash, one window over the hashes of the single bucket that holds the cut, and, where rows equal in
hash and size straddle it, counts of those rows by partition of the settled table.  So a source misses its
target by half a document at most, also where most of its rows are alike.

Only the patterns and sources reach the driver, at most ``MOST_PATTERNS`` of them (more raise an error).

Defined results: a null text has no words; a null source is a source of its own and comes last; a very long
text is one document and is taken whole or not; of rows equal in id, text and size as many are taken as
are due, whichever; an empty table, and one without words, gives targets of 0; columns that documents
have besides are kept, and where one has a name that ``mixed`` adds, the added one gets underscores after it.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, free_names, settle, words_of

WEIGHTS = (5, 2, 1)
REPEATS = 3
SEED = "mix-1"
#: Membership patterns (and sources) that the flow takes; a bound on what is collected and broadcast.
MOST_PATTERNS = 100_000
#: The selection hash has 60 bits; its first 12 are the histogram's bucket.
HASH_DIGITS, LOW_BITS = 15, 48
#: Columns that ``mixed`` adds.
ADDED = ["mix_size", "mix_key", "mix_taken", "mix_source_size", "mix_target", "mix_routes"]


def source_key(source: Column) -> Column:
    """A source as a string that is never null; the null source is '-'."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def _by_code_point(key: str) -> tuple:
    return (key == "-", key.encode())


def targets(sizes: dict[str, int], weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, total: int | None = None) -> dict[str, tuple[int, int]]:
    """Each source's share of ``total`` (None: all sizes) as a fraction (numerator, denominator).

    Weights repeat over the sources by code point.  No share is above ``repeats`` times the source's size;
    what is above is shared again by weight.
    """
    order = sorted(sizes, key=_by_code_point)
    weight = {k: weights[i % len(weights)] for i, k in enumerate(order)}
    left, open_, share = sum(sizes.values()) if total is None else total, set(order), {}
    while open_:
        whole = sum(weight[k] for k in open_)
        above = [k for k in open_ if weight[k] * left > repeats * sizes[k] * whole]
        if not above:
            return share | {k: (weight[k] * left, whole) for k in open_}
        for k in above:
            share[k] = (repeats * sizes[k], 1)
        left -= sum(repeats * sizes[k] for k in above)
        open_ -= set(above)
    return share


def min_cost_flow(supply: dict[str, int], members: dict[str, list[str]], quota: dict[str, int], repeats: int = REPEATS) -> dict[tuple[str, str], int]:
    """Tokens from each pattern to each source: a largest flow, and among those one of least repetition cost.

    Successive cheapest paths, separately in each connected part of the graph of patterns and sources.
    """
    routed: dict[tuple[str, str], int] = {}
    holders = defaultdict(list)
    for p, sources in members.items():
        for q in sources:
            holders[q].append(p)
    seen: set[str] = set()
    for first in sorted(members):
        if first in seen:
            continue
        seen.add(first)
        part, reach, todo = [], set(), [first]
        while todo:
            part.append(p := todo.pop())
            for q in members[p]:
                if q not in reach:
                    reach.add(q)
                    fresh = [x for x in holders[q] if x not in seen]
                    seen.update(fresh)
                    todo += fresh
        routed |= _part_flow(sorted(part), supply, members, quota, repeats)
    return routed


def _part_flow(part: list[str], supply: dict, members: dict, quota: dict, repeats: int) -> dict[tuple[str, str], int]:
    arcs: list[list] = []  # to, capacity left, cost; the reverse of arc i is i ^ 1
    out = defaultdict(list)

    def arc(a, b, capacity, cost):
        out[a].append(len(arcs))
        arcs.append([b, capacity, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0, -cost])

    between = {}
    for p in part:
        for k in range(1, repeats + 1):
            arc("start", ("p", p), supply[p], 2 * k - 1)
        for q in members[p]:
            between[p, q] = len(arcs)
            arc(("p", p), ("q", q), repeats * supply[p], 0)
    for q in sorted({q for p in part for q in members[p]}, key=_by_code_point):
        arc(("q", q), "end", quota[q], 0)
    while True:
        cost, via, queue, queued = {"start": 0}, {}, deque(["start"]), {"start"}
        while queue:
            queued.discard(a := queue.popleft())
            for i in out[a]:
                b, capacity, c = arcs[i]
                if capacity > 0 and cost[a] + c < cost.get(b, 1 << 60):
                    cost[b], via[b] = cost[a] + c, i
                    if b not in queued:
                        queue.append(b)
                        queued.add(b)
        if "end" not in cost:
            return {pq: arcs[i ^ 1][1] for pq, i in between.items()}
        path, at = [], "end"
        while at != "start":
            path.append(via[at])
            at = arcs[via[at] ^ 1][0]
        amount = min(arcs[i][1] for i in path)
        for i in path:
            arcs[i][1] -= amount
            arcs[i ^ 1][1] += amount


def selection_hash(id_column: Column, text: Column, seed: str = SEED) -> Column:
    whole = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(whole), 1, HASH_DIGITS), 16, 10).cast("long")


def mixed(docs: DataFrame, sources: Column | None = None, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = SEED, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (of its columns those in ``carry``; default: all) with the columns ADDED.

    mix_taken: the tokens taken, repetitions counted.  mix_source_size and mix_target are those of the first
    of a document's sources by code point.  mix_routes: how many tokens of its pattern go to each source.
    ``sources``: an array column of the sources that hold a document (default: its one ``source``).
    """
    rows, plan = _planned(docs, sources, size, weights, repeats, seed, carry)
    out = rows.join(plan, rows.p == plan.pattern, "left").withColumn("times", _times())
    names = free_names(docs.columns if carry is None else carry, *ADDED)
    values = [F.col("n"), F.col("p"), F.col("n") * F.col("times"), F.col("source_size"), F.col("target"), F.col("routes")]
    return out.select("row.*", *[v.alias(n) for v, n in zip(values, names)])


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it, columns as they are."""
    rows, plan = _planned(docs, **options)
    out = rows.join(plan, rows.p == plan.pattern, "left").where("n > 0").select("row", F.explode(F.array_repeat(F.lit(1), _times())).alias("copy"))
    return out.select("row.*")


def _place() -> Column:
    return F.struct(F.col("h").alias("h"), F.col("n").alias("n"), F.col("at").alias("at"))


def _times() -> Column:
    """How often a row of the planned table is taken."""
    return F.coalesce(F.col("whole") + F.when(_place() <= F.col("cut"), 1).otherwise(0), F.lit(0)).cast("int")


def _planned(docs: DataFrame, sources: Column | None = None, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = SEED, carry: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): settled (row, p, n, h, at), and for each pattern its flow; ``at`` tells equal rows apart."""
    spark = docs.sparkSession
    sources = F.array("source") if sources is None else sources
    keys = F.array_sort(F.array_distinct(F.transform(sources, source_key)))
    size = F.size(words_of(F.col("text"))).cast("long") if size is None else size
    marked = carried(docs, keys=keys, n=size, h=selection_hash(F.col("doc_id"), F.col("text"), seed))
    if carry is not None:
        marked = marked.withColumn("row", F.struct(*[F.col("row")[c].alias(c) for c in carry]))
    marked = marked.select("row", "keys", F.array_join("keys", "\u0001").alias("p"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), "h")
    rows = settle(marked.withColumn("at", F.monotonically_increasing_id()))
    patterns = rows.groupBy("p").agg(F.sum("n").alias("size"), F.first("keys").alias("keys")).limit(MOST_PATTERNS + 1).collect()
    if len(patterns) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    supply = {r.p: r["size"] for r in patterns}
    members = {r.p: list(r["keys"] or []) for r in patterns}
    sizes: dict[str, int] = defaultdict(int)
    for k, own in members.items():
        for q in own:
            sizes[q] += supply[k]
    share = targets(sizes, weights, repeats, sum(supply.values()))
    flow = min_cost_flow(supply, members, {q: (2 * a + b) // (2 * b) for q, (a, b) in share.items()}, repeats)
    through, routes = defaultdict(int), defaultdict(list)
    for (p, q), x in sorted(flow.items()):
        through[p] += x
        routes[p].append((None if q == "-" else q[1:], x))
    plan = [
        (p, min(through[p] // s if s else 0, repeats), through[p] % s if s else 0, sizes[members[p][0]], share[members[p][0]][0] / share[members[p][0]][1], routes[p])
        for p, s in supply.items()
        if members[p]
    ]
    plan = spark.createDataFrame(plan, "pattern string, whole long, rest long, source_size long, target double, routes array<struct<source:string,tokens:long>>")
    return rows, F.broadcast(plan.join(_cuts(rows, plan), "pattern", "left"))  # at most MOST_PATTERNS rows


def _cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(pattern, cut): the last (h, n, at) of each pattern that its further selection takes."""
    need = F.broadcast(plan.where("rest > 0").select("pattern", "rest"))
    bucket = F.shiftright("h", LOW_BITS)
    slim = rows.select("p", "h", "n", "at", bucket.alias("bucket"))
    in_order = Window.partitionBy("p").orderBy("bucket")
    histogram = slim.groupBy("p", "bucket").agg(F.sum("n").alias("tokens"))
    histogram = histogram.withColumn("upto", F.sum("tokens").over(in_order)).join(need, F.col("p") == F.col("pattern"))
    at = histogram.where("upto >= rest and upto - tokens < rest")
    at = settle(at.select("pattern", F.col("bucket").alias("cut_bucket"), (F.col("rest") - F.col("upto") + F.col("tokens")).alias("rest")))
    inside = slim.join(F.broadcast(at), (F.col("p") == F.col("pattern")) & (F.col("bucket") == F.col("cut_bucket")))
    # the last group of equal rows that is reached, and how many of its rows are due: the nearest whole number, halves up
    alike = inside.groupBy("pattern", "h", "n").agg(F.count("*").alias("rows"), F.first("rest").alias("rest"))
    order = Window.partitionBy("pattern").orderBy("h", "n")
    alike = alike.withColumn("upto", F.sum(F.col("n") * F.col("rows")).over(order)).withColumn("before", F.col("upto") - F.col("n") * F.col("rows"))
    due = F.when(F.col("n") == 0, F.col("rows")).otherwise(F.least(F.floor((2 * (F.col("rest") - F.col("before")) + F.col("n")) / (2 * F.col("n"))), F.col("rows")))
    reached = alike.where("before < rest").withColumn("due", due).where("due > 0")
    last = reached.groupBy("pattern").agg(F.max(F.struct("h", "n", "due", "rows")).alias("last")).select("pattern", "last.*")
    last = settle(last)
    # which of the equal rows: by partition of the settled table, then by place in the one partition that holds the cut
    split = F.broadcast(last.where("due < rows").select("pattern", F.col("h").alias("cut_h"), F.col("n").alias("cut_n"), "due"))
    peers = inside.drop("rest").join(split, "pattern").where("h = cut_h and n = cut_n").withColumn("part", F.shiftright("at", 33))
    parts = peers.groupBy("pattern", "part").agg(F.count("*").alias("rows"), F.first("due").alias("due"))
    parts = parts.withColumn("upto", F.sum("rows").over(Window.partitionBy("pattern").orderBy("part"))).where("upto >= due and upto - rows < due")
    parts = F.broadcast(parts.select("pattern", "part", (F.col("due") - F.col("upto") + F.col("rows")).alias("nth")))
    ranked = peers.select("pattern", "part", "at").join(parts, ["pattern", "part"]).withColumn("place", F.row_number().over(Window.partitionBy("pattern", "part").orderBy("at")))
    chosen = ranked.where("place = nth").select("pattern", F.col("at").alias("cut_at"))
    everything = F.lit((1 << 63) - 1)
    found = last.join(chosen, "pattern", "left").select("pattern", F.struct(F.col("h"), F.col("n"), F.coalesce("cut_at", everything).alias("at")).alias("cut"))
    # nothing in the cut bucket is taken: everything before the bucket is
    floor = F.struct(F.shiftleft("cut_bucket", LOW_BITS).alias("h"), F.lit(-1).cast("long").alias("n"), F.lit(0).cast("long").alias("at"))
    return at.join(found, "pattern", "left").select("pattern", F.coalesce("cut", floor).alias("cut"))


#: The rows of op2 in DuckDB SQL: with one source a document the flow has one path for each source.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS k FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE k WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM s),
o AS (
  SELECT *, (SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER b, 0) AS remaining, (SELECT sum(w) FROM w) - coalesce(sum(w) OVER b, 0) AS weights
  FROM w WINDOW b AS (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT remaining, weights FROM o WHERE w * remaining <= cap * weights ORDER BY cap / w, encode(source) NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size,
    CASE WHEN w * f.remaining > cap * f.weights THEN CAST(cap AS DOUBLE) ELSE CAST(w * f.remaining AS DOUBLE) / CAST(f.weights AS DOUBLE) END AS target
  FROM w, f),
q AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), 3 * source_size) AS flow FROM t),
r AS (SELECT *, CASE WHEN source_size > 0 THEN flow // source_size ELSE 0 END AS whole, CASE WHEN source_size > 0 THEN flow % source_size ELSE 0 END AS rest FROM q),
c AS (
  SELECT d.*, r.source_size, r.target, r.whole, r.rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY u, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN rest > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
