import random
import zlib

from tidemark.llm import sharding


def check(spark, rows, shards, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as range", "3 as bucket")
    got = sharding.assign_shards(docs, shards, **options).collect()
    raw = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows]
    assert sorted(map(str, ((r.doc_id, r["size"], r.text_crc32) for r in got))) == sorted(map(str, raw))
    most, total = max((x[1] for x in raw), default=0), sum(x[1] for x in raw)
    used = {}
    for r in got:
        used.setdefault(r.shard, []).append(r)
    for s, own in used.items():
        assert 0 <= s < shards
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / shards) <= max(most, total / shards / sharding.LARGE)
    return got


def test_equal_texts_stay_together(spark):
    """A group of equal texts is in one shard unless no shard has room for it."""
    rng = random.Random(3)
    rows, share = [], 0
    for g in range(400):
        text = "".join(rng.choices("abcdef", k=rng.randint(1, 300)))
        rows += [(len(rows) + i, text) for i in range(rng.choice([1, 2, 3, 3, 20 if g % 9 == 0 else 2]))]
    rows += [(10**6 + i, "hot text " * 20) for i in range(900)]
    rng.shuffle(rows)
    got = check(spark, rows, 8, rows_per_range=50)
    shards = {}
    for r in got:
        shards.setdefault((r.text_crc32, r["size"]), set()).add(r.shard)
    spread = {k for k, v in shards.items() if len(v) > 1}
    assert spread == {(zlib.crc32(b"hot text " * 20), 196)}


def test_shards_are_even(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("aé ", k=rng.randint(0, 400))) for _ in range(200)]
    rows = [(i, "hot " * 50 if i % 3 == 0 else rng.choice(texts)) for i in range(3000)] + [(5, None), (None, "x"), (7, "b" * 30_000), (9, "same"), (9, "same")]
    first = check(spark, rows, 7, rows_per_range=40)
    assert sorted(map(str, first)) == sorted(map(str, check(spark, rows, 7, rows_per_range=40)))
    check(spark, rows[:3], 40)
    check(spark, [(i, "t") for i in range(500)], 5)
    check(spark, [], 4)


def test_written_shards(spark, tmp_path):
    rows = [(i % 150 if i % 7 else None, "t" * (i % 50), f"s{i}", f"l{i}", i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot string, at int")
    sharding.write_shards(docs, str(tmp_path / "out"), 4, rows_per_range=20)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select(*docs.columns).collect()), key=str) == sorted(rows, key=str) and back.select("shard_").distinct().count() == 4
