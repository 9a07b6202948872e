import random

import numpy as np
import pytest

from tidemark.llm import near_copies
from tidemark.llm.common import settle


def similarity(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def planted():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))
    texts = []
    for _ in range(60):
        words = [word() for _ in range(rng.randint(80, 300))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(1, 4)):  # copies with a few changed words, some less alike than 0.8
            changed = list(words)
            for _ in range(rng.randint(1, 14)):
                changed[rng.randrange(len(changed))] = word()
            texts.append(" ".join(changed))
    rng.shuffle(texts)
    return texts


def components(texts):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_components_match_all_pairs(spark):
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert [got[i] for i in range(len(texts))] == components(texts)
    assert 60 < len(set(got.values())) < len(texts)


def test_stage_drops_near_copies(spark):
    import corpus_pipeline

    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert {r.doc_id for r in settle(stage(spark, docs, "")).collect()} == set(components(texts))


def test_large_group_and_odd_rows(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(300):  # one word of each differs
        changed = list(words)
        changed[i % 200] = f"x{i}"
        rows.append((i, " ".join(changed)))
    rows += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b"), (None, "a text without any id at all"), (None, "a text without any id at all"), (1004, "c d")]
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["0", "1000", "1002", "1004", "None"])


def test_a_chain_in_shared_buckets(spark):
    """Members that are not near to the first of their bucket are linked as well."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    chain = []
    for i in range(40):  # neighbours are near copies, ends are not
        words = list(words)
        words[i] = f"x{i}"
        chain.append(" ".join(words))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(chain)], "doc_id long, text string")
    assert [r.component_id for r in near_copies.near_copies(docs).orderBy("doc_id").collect()] == components(chain)


def test_a_shared_passage_makes_few_pairs(spark, monkeypatch):
    """Texts with a long passage in common are no near copies; candidates grow with them, not with their square."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(100)]
    texts = [" ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(40)]) for _ in range(300)]
    texts += [texts[i] + " more" for i in range(0, 300, 30)]
    seen, verify = [], near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda sets, pairs: (seen.append(pairs.count()), verify(sets, pairs))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == {i: i if i < 300 else 30 * (i - 300) for i in range(310)}
    assert sum(seen) < 60 * 310


def test_repeated_ids_and_clashing_columns(spark):
    text = lambda s: " ".join(f"{s}{i}" for i in range(60))
    rows = [(1, text("a")), (5, text("a")), (5, text("b")), (7, text("c")), (7, text("d")), (None, text("e")), (None, text("e")), (None, text("a")), (9, text("f")), (9, text("f"))]
    names = ["keep_id", "i", "rk1", "k1", "k2", "row", "label", "node", "component_id", "count", "copies", "stays", "id", "u"]
    docs = spark.createDataFrame([(*r, *[f"{n}{at}" for n in names]) for at, r in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    from tidemark.llm import simhash

    for keep in (near_copies.keep_one, simhash.keep_one):
        kept = keep(docs)
        assert kept.columns == docs.columns
        got = kept.collect()
        assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, [(1, text("a")), (5, text("b")), (7, text("c")), (7, text("d")), (None, text("e")), (9, text("f"))]))
        for r in got:
            at = int(r.keep_id[len("keep_id") :])
            assert tuple(r) == (*rows[at], *[f"{n}{at}" for n in names])


def shared_passage(most, pairs, seed=4):
    """Texts alike by 0.787, no links, and some that share one more word with one of them (0.802), in one crowd of buckets."""
    rng = random.Random(seed)
    own = lambda k: [f"w{rng.randrange(10**9)}" for _ in range(k)]
    passage = [f"p{i}" for i in range(100)]
    ends = [own(13) for _ in range(most)]
    return [" ".join(passage + e) for e in ends] + [" ".join(passage + e[:1] + own(12)) for e in ends[:pairs]]


def test_a_link_whose_buckets_have_other_leaders(spark):
    texts = shared_passage(240, 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == {i: i if i < 240 else i - 240 for i in range(280)}


def test_all_links_in_blocks_and_without_an_order(spark, monkeypatch):
    """Shingles of many nodes are compared in pairs of blocks; the order of the shingles changes no link."""
    texts = shared_passage(60, 20) + planted()[:60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    monkeypatch.setattr(near_copies, "_common", lambda docs: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    assert [r.component_id for r in near_copies.near_copies(docs).orderBy("doc_id").collect()] == components(texts)


def test_first_shingles_and_parities_lose_no_similar_pair():
    rng = np.random.default_rng(2)
    pool = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64))
    common = np.sort(rng.choice(pool, 1500, replace=False))
    ranks = rng.permutation(len(common))
    met = 0
    for _ in range(2000):
        a = np.unique(rng.choice(pool, rng.integers(1, 200), replace=False))
        b = np.union1d(rng.choice(a, rng.integers(len(a) * 3 // 4, len(a) + 1), replace=False), rng.choice(pool, rng.integers(0, len(a) // 4 + 1), replace=False))
        x, y = near_copies.parities(a), near_copies.parities(b)
        assert near_copies.apart(x, y) == near_copies.apart(y, x) <= len(np.setxor1d(a, b))
        if len(b) and near_copies.similar(a, b):
            met += 1
            assert len(np.intersect1d(near_copies.prefix_of(a, common, ranks), near_copies.prefix_of(b, common, ranks)))
    assert 300 < met < 1900
    assert not len(near_copies.prefix_of(np.zeros(0, np.uint64), common, ranks))


def test_settled_steps_leave_no_shuffle_files(spark):
    """Else a stage's shuffles stay on disk, all of them, until the driver collects its garbage."""
    from pyspark.sql import functions as F

    from tidemark.llm.common import settle

    def held():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = held()
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    out = settle(rows)
    assert not held() - before
    assert out.count() == 7 and rows.count() == 7
