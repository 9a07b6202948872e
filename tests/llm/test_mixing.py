import random

from tidemark.llm import mixing


def test_targets_share_and_stop_at_three_times():
    share = mixing.targets({"=a": 10, "=b": 1000, "-": 500, "=c": 40})
    value = {k: a / b for k, (a, b) in share.items()}
    assert value["=a"] == 30  # 5 of 13 parts of 1550 is above 3 * 10
    assert abs(sum(value.values()) - 1550) < 1e-6
    assert value["=c"] == 120 and abs(value["=b"] / value["-"] - 2 / 5) < 1e-9  # weights by place: 5, 2, 1, 5
    assert mixing.targets({}) == {} and mixing.targets({"=a": 0}) == {"=a": (0, 5)}


def test_flow_is_largest_and_cheapest():
    rng = random.Random(3)
    for _ in range(20):
        patterns = {f"p{i}": rng.randint(1, 6) for i in range(4)}
        sources = ["=a", "=b", "=c"]
        members = {p: sorted(rng.sample(sources, rng.randint(1, 2))) for p in patterns}
        quota = {s: rng.randint(0, 9) for s in sources}
        flow = mixing.min_cost_flow(patterns, members, quota)
        through = {p: sum(x for (a, _), x in flow.items() if a == p) for p in patterns}
        filled = {s: sum(x for (_, b), x in flow.items() if b == s) for s in sources}
        assert all(through[p] <= 3 * patterns[p] for p in patterns) and all(filled[s] <= quota[s] for s in sources)
        assert (sum(filled.values()), -_cost(patterns, through)) == _best(patterns, members, quota)


def _cost(supply, through):
    return sum((2 * k + 1) * max(0, min(supply[p], through[p] - k * supply[p])) for p in supply for k in range(3))


def _best(supply, members, quota):
    """All ways, token by token, over what each pattern sends to each source."""
    states = {tuple(sorted(quota.items())): 0}
    for p, size in supply.items():
        new = {}
        for left, cost in states.items():
            left = dict(left)
            a, b = (members[p] * 2)[:2]
            for x in range(min(left[a], 3 * size) + 1):
                for y in range(min(left[b], 3 * size - x) + 1) if b != a else [0]:
                    rest = dict(left)
                    rest[a] -= x
                    rest[b] -= y
                    key = tuple(sorted(rest.items()))
                    new[key] = min(new.get(key, 1 << 30), cost + _cost({p: size}, {p: x + y}))
        states = new
    total = sum(quota.values())
    return max((total - sum(v for _, v in k), -c) for k, c in states.items())


def test_mix_of_a_table(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["s1", "s2", "S3", None, "é"]), " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(400, "s1", None), (401, "s1", ""), (402, "s2", "long " * 3000), (3, rows[3][1], rows[3][2]), (None, "s2", "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "7 as mix_plan", "1 as size")
    out = [r.asDict() for r in mixing.mixed(docs).collect()]
    assert sorted(map(str, ((r["doc_id"], r["mix_taken"]) for r in out))) == sorted(map(str, ((r["doc_id"], r["mix_taken"]) for r in mixing.mixed(docs).collect())))
    assert len(out) == len(rows)
    for r in out:
        assert r["mix_size"] == len((r["text"] or "").split()) and 0 <= r["mix_taken"] <= 3 * r["mix_size"]
    for s in {r[1] for r in rows}:
        mine = [r for r in out if r["source"] == s]
        assert abs(sum(r["mix_taken"] for r in mine) - mine[0]["mix_target"]) <= max(r["mix_size"] for r in mine) / 2 + 1
        assert mine[0]["mix_source_size"] == sum(r["mix_size"] for r in mine)
    again = mixing.repeated(docs)
    assert again.columns == docs.columns and again.count() == sum(r["mix_taken"] // r["mix_size"] for r in out if r["mix_size"])
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_overlapping_sources(spark):
    from pyspark.sql import functions as F

    rows = [(i, ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b"], "x y z") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, held array<string>, text string")
    out = mixing.mixed(docs, sources=F.col("held")).collect()
    assert len(out) == 90 and abs(sum(r.mix_taken for r in out) - 270) <= 6
    for r in out:  # what patterns send to each source adds up to the sources' targets
        assert {x.source for x in r.mix_routes} <= set(r.held)
    routes = {r.mix_key: r.mix_routes for r in out}
    got = {s: sum(x.tokens for own in routes.values() for x in own if x.source == s) for s in "ab"}
    target = {s: a / b for s, (a, b) in mixing.targets({"=a": 180, "=b": 180}, total=270).items()}
    assert all(abs(got[s] - target["=" + s]) <= 1 for s in "ab")


def test_equal_rows_meet_the_target(spark):
    """Rows equal in id and text, and rows without id, are not taken or left all together."""
    rows = [(7, "a", "w " * 100)] * 100 + [(None, "b", f"x{i} " * 50) for i in range(100)] + [(i, "c", "v " * 20) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(7)
    out = mixing.mixed(docs).collect()
    for s in "abc":
        mine = [r for r in out if r.source == s]
        assert abs(sum(r.mix_taken for r in mine) - mine[0].mix_target) <= mine[0].mix_size / 2 + 1, s
    key = lambda rows: sorted(str((r.doc_id, r.source, r.text, r.mix_taken)) for r in rows)
    assert key(out) == key(mixing.mixed(docs.repartition(3)).collect())


def test_clashing_columns_keep_their_values(spark):
    names = ["rest", "whole", "cut", "mix_key", "mix_size", "mix_copy", "n", "h", "p", "at", "row", "keys", "pattern", "target"]
    rows = [(i, f"s{i % 3}", "w " * (i % 9), *[f"{n}{i}" for n in names]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, " + ", ".join(f"{n} string" for n in names))
    out = mixing.mixed(docs)
    assert out.columns == [*docs.columns, "mix_size_", "mix_key_", "mix_taken", "mix_source_size", "mix_target", "mix_routes"]
    assert sorted(tuple(r)[: len(docs.columns)] for r in out.collect()) == rows
    times = {r.doc_id: r.mix_taken // r.mix_size_ if r.mix_size_ else 0 for r in out.collect()}
    again = mixing.repeated(docs)
    assert again.columns == docs.columns
    assert sorted(map(tuple, again.collect())) == sorted(r for r in rows for _ in range(times[r[0]]))
