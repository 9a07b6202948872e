"""Shards of near-equal bytes from sampled splitters, with DataFrame functions only.

The key of a document is a hash of its text, so equal texts stand together.  A sample takes each row with a
probability in proportion to its size; equal steps of the sample's weight are the splitters, which
range-partition all rows into ranges of about equal bytes.  Ranges that turn out overfull are sampled
again, more densely, and subdivided.  That makes every range small enough for one window, which gives each
row its exact place in the global order of bytes.  What the sample buys is the bounded range, not the
last byte: a shard's end falls inside a range, and the exact places there decide it.

Equal texts are a group and go to one shard.  Groups of more than 1 / ``LARGE`` of a shard (there are at most
``LARGE`` for each shard) are placed first, largest first, into the emptiest shard; one that no shard has
room for is spread over shards by rows.  All else fills what room the shards have left, in order; a small
group goes by its middle.  So shards differ by one document or 1 / ``LARGE`` of a shard at most.

At most ``MOST_RANGES`` splitters are broadcast.  The driver sees two totals, the large groups' sizes and
whether tables are empty.

Defined results: a null text has no bytes (the checksum of an empty text); a very long text is one row and may
make its shard larger by itself; rows equal in id and text are alike and take neighbouring slots; a null doc_id
comes first in a group that is spread; with fewer rows than shards some shards stay empty; an empty table
gives an empty result; further columns are ignored, and kept as they are by ``write_shards``.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, free_names, settle

SHARDS = 40
#: Bytes that a row costs besides its text.
ROW_BYTES = 16
#: Ranges: at least this many for each shard, and one for each so many rows.
RANGES_PER_SHARD, ROWS_PER_RANGE, MOST_RANGES = 4, 50_000, 20_000
#: Sampled rows for each wanted range.
OVERSAMPLE = 24
#: Times its due size from which on a range is subdivided, and how often that is tried.
OVERFULL, ROUNDS = 2.0, 3
#: Groups of equal texts above this part of a shard are placed one by one.
LARGE = 50
#: Leading bits of the text hash that find the splitters near a key.
BUCKET_BITS = 12


def _keyed(docs: DataFrame, id_column: str, text_column: str, carry: bool = False) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    columns = {
        "doc_id": F.col(id_column).cast("long"),
        "size": F.octet_length(text).cast("long") + ROW_BYTES,
        "text_crc32": F.crc32(text.cast("binary")),
        "key": F.xxhash64(text),
    }
    out = carried(docs, **columns)
    return (out if carry else out.drop("row")).withColumn("at", F.monotonically_increasing_id())


#: What equal texts have in common.
GROUP = ["key", "size", "text_crc32"]


def _place() -> Column:
    """A row's place in the global order; rows of a small group share theirs, so no splitter falls into it."""
    apart = lambda c: F.when(F.col("large"), F.col(c)).alias(c)
    return F.struct(F.col("key").alias("k"), F.col("size").alias("s"), F.col("text_crc32").alias("c"), apart("doc_id"), apart("at"))


def _large_groups(rows: DataFrame, total: int, shards: int) -> tuple[list, list[float]]:
    """((*GROUP, fixed) of each large group, what room each shard has left); fixed: its shard, None: spread by rows."""
    share = total / shards
    found = rows.groupBy(*GROUP).agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    found = found.where((F.col("rows") > 1) & (F.col("bytes") > share / LARGE)).collect()  # LARGE * shards rows at most
    room, out = [(-share, s) for s in range(shards)], []
    for g in sorted(found, key=lambda g: (-g.bytes, g.key, g["size"], g.text_crc32)):
        left, s = heapq.heappop(room)
        fits = g.bytes <= -left
        heapq.heappush(room, (left + g.bytes if fits else left, s))
        out.append((g.key, g["size"], g.text_crc32, s if fits else None))
    return out, [-left for left, _ in sorted(room, key=lambda x: x[1])]


def _splitters(rows: DataFrame, within: str, total: Column, ranges: Column, salt: int) -> DataFrame:
    """(within, place): the splitters that cut each ``within`` group of ``total`` bytes into about ``ranges``."""
    step = total / (ranges * OVERSAMPLE)  # bytes that a sampled row stands for
    chance = F.pmod(F.xxhash64("key", "doc_id", "at", F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.where(chance * step < F.col("size")).select(within, _place().alias("place"), F.greatest(F.col("size").cast("double"), step).alias("weight"), ranges.alias("ranges"))
    sample = sample.groupBy(within, "place").agg(F.sum("weight").alias("weight"), F.first("ranges").alias("ranges"))
    order = Window.partitionBy(within).orderBy("place")
    upto = F.sum("weight").over(order)
    share = F.floor(upto * F.col("ranges") / F.sum("weight").over(Window.partitionBy(within)))
    marked = sample.withColumn("share", share).withColumn("before", F.lag("share", 1, 0).over(order))
    return marked.where("share > before").select(within, "place")


def _ranged(rows: DataFrame, splitters: DataFrame) -> DataFrame:
    """``rows`` with ``range``: how many splitters are at or before a row's place."""
    spark = rows.sparkSession
    shift = 64 - BUCKET_BITS
    near = splitters.groupBy(F.shiftright(F.col("place.k"), shift).alias("bucket")).agg(F.array_sort(F.collect_list("place")).alias("near"))
    half = 1 << (BUCKET_BITS - 1)
    buckets = spark.range(-half, half, 1, 1).select(F.col("id").alias("bucket")).join(near, "bucket", "left")
    here = F.coalesce(F.size("near"), F.lit(0))
    before = F.sum(here).over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    buckets = buckets.withColumn("base", F.coalesce(before, F.lit(0)))  # 2^BUCKET_BITS rows, MOST_RANGES places
    out = rows.withColumn("bucket", F.shiftright("key", shift)).join(F.broadcast(buckets), "bucket").withColumn("place", _place())
    steps = F.array(*[F.lit(1 << b) for b in range(MOST_RANGES.bit_length(), -1, -1)])
    halved = F.aggregate(
        steps,
        F.lit(0),
        lambda low, step: F.when((low + step <= F.size("near")) & (F.get(F.col("near"), low + step - 1) <= F.col("place")), low + step).otherwise(low),
    )
    within = F.when(F.col("near").isNull(), F.lit(0)).otherwise(halved)
    return out.withColumn("range", (F.col("base") + within).cast("long")).drop("bucket", "near", "base")


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text_column: str = "text", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row; shards hold near-equal bytes, slots have no gaps."""
    rows = settle(_keyed(docs, id_column, text_column))
    return _assigned(rows, shards, rows_per_range).select("doc_id", "size", "text_crc32", "shard", "slot")


def _assigned(keyed: DataFrame, shards: int, rows_per_range: int) -> DataFrame:
    """``keyed`` (settled) with shard and slot."""
    spark = keyed.sparkSession
    rows = keyed.select("doc_id", *GROUP, "at")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    groups, room = _large_groups(rows, total, shards)
    known = spark.createDataFrame([(*g, True) for g in groups], "key long, size long, text_crc32 long, fixed int, large boolean")
    rows = rows.join(F.broadcast(known), GROUP, "left").withColumn("large", F.coalesce("large", F.lit(False)))
    ranges = min(MOST_RANGES // 2, max(RANGES_PER_SHARD * shards, count // rows_per_range))
    splitters = settle(_splitters(rows.withColumn("all", F.lit(0)), "all", F.lit(float(total)), F.lit(ranges), 0).select("place"))
    ranged = _ranged(rows, splitters)
    for turn in range(1, ROUNDS + 1):
        filled = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.min("place").alias("a"), F.max("place").alias("b"))
        due = float(total) / ranges
        over = filled.where((F.col("bytes") > OVERFULL * due) & (F.col("a") < F.col("b")))
        over = settle(over.select("range", F.col("bytes").cast("double").alias("bytes"), F.ceil(F.col("bytes") / due * 2).cast("int").alias("parts")))
        if over.isEmpty():
            break
        inside = ranged.join(F.broadcast(over), "range")
        more = _splitters(inside, "range", F.col("bytes"), F.col("parts"), turn).select("place")
        splitters = settle(splitters.unionByName(more).distinct())
        ranged = _ranged(rows, splitters)
    # a row is loose unless its group has a shard; only loose rows fill the room that is left, in order
    ranged = ranged.withColumn("loose", F.when(F.col("fixed").isNull(), F.col("size")).otherwise(0))
    free = F.col("fixed").isNull().cast("long")
    upto = Window.partitionBy("range").orderBy(*GROUP, "doc_id", "at").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumns({"loose_upto": F.sum("loose").over(upto), "nth": F.count("*").over(upto), "nth_loose": F.sum(free).over(upto)})
    group = Window.partitionBy("range", *GROUP)
    placed = placed.withColumns({"group_upto": F.max("loose_upto").over(group), "group_bytes": F.sum("loose").over(group)})
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # MOST_RANGES rows at most
    filled = ranged.groupBy("range").agg(F.sum("loose").alias("loose"), F.count("*").alias("rows"), F.sum(free).alias("free"))
    before = {"loose_before": "loose", "rows_before": "rows", "free_before": "free"}
    starts = filled.select("range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(n) for n, c in before.items()])
    placed = placed.join(F.broadcast(starts), "range")
    spread = F.col("large")
    middle = F.col("loose_before") + F.when(spread, F.col("loose_upto") - F.col("size") / 2).otherwise(F.col("group_upto") - F.col("group_bytes") / 2)
    ends, filled_to = [], 0.0
    for x in room[:-1]:
        filled_to += x
        ends.append(filled_to)
    shard = F.coalesce("fixed", F.size(F.filter(F.array(*[F.lit(e) for e in ends]).cast("array<double>"), lambda e: e <= middle)))
    row = F.when(F.col("fixed").isNull(), F.col("free_before") + F.col("nth_loose")).otherwise(F.col("rows_before") + F.col("nth"))
    # runs: the loose rows of a shard, or one of its groups; each counts from 0 and starts where those before it end
    named = {f"run_{c}": F.when(F.col("fixed").isNotNull(), F.col(c)) for c in GROUP}
    placed = settle(placed.select("doc_id", *GROUP, "at", shard.cast("int").alias("shard"), row.alias("row_number"), *[v.alias(n) for n, v in named.items()]))
    run = ["shard", *named]
    runs = placed.groupBy(*run).agg(F.min("row_number").alias("first"), F.count("*").alias("rows"))  # shards and large groups
    base = F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy(*named).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("base", base).select(*[F.col(c).alias(f"of_{c}") for c in run], "first", "base")
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in run]
    placed = placed.join(F.broadcast(runs), same).withColumn("slot", (F.col("base") + F.col("row_number") - F.col("first")).cast("long"))
    return placed.select("doc_id", *GROUP, "at", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, rows_per_range: int = ROWS_PER_RANGE) -> None:
    """Write the rows of ``docs`` as Parquet, a folder for each shard (column ``shard``, with underscores after it
    where ``docs`` has one).  A shard is written by several tasks, in runs of ``rows_per_range`` slots."""
    keyed = settle(_keyed(docs, "doc_id", "text", carry=True))
    dealt = _assigned(keyed, shards, rows_per_range).select(F.col("at").alias("own"), F.col("shard").alias("to"), "slot")
    (name,) = free_names(docs.columns, "shard")
    out = keyed.select("row", "at").join(dealt, F.col("at") == F.col("own")).withColumn("run", F.floor(F.col("slot") / rows_per_range))
    out = out.repartition(shards, "to", "run").sortWithinPartitions("to", "slot")
    out.select("row.*", F.col("to").alias(name)).write.partitionBy(name).parquet(path)
