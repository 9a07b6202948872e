import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import divergence

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def slow(rows, least, ranks=50):
    docs = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    found = [(lang, source, WORD.findall(text.translate(lower))) for text, lang, source in docs]
    out = []
    for lang in {d[1] for d in docs}:
        seen = Counter(t for la, _, words in found if la == lang for t in set(words))
        kept = {t for t, n in seen.items() if n >= least}
        counts = {s: Counter() for _, la, s in docs if la == lang}
        for la, s, words in found:
            if la == lang:
                counts[s].update(w for w in words if w in kept)
        part = lambda c: {t: 1 + (10**9 * (c[t] + 5)) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: part(c) for s, c in counts.items()}, part(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in counts if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(sorted(terms)[:ranks])]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 as term", "2 as counts", "3 as Item").repartition(5)
    return sorted(tuple(r) for r in divergence.audit(df, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def fixture(seed, n=400):
    rng = random.Random(seed)
    words = ["a", "ab", "abc", "abd", "été", "ÉTÉ", "日本", "日", "𝒳", "Ab", "ABC", "xy-z", "it's", "é", "z" * 300, "\x80", "b\x00c", "naïve"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(0, 30))), rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s1", "s2", "é", None, "S1", "\U0001f600"])) for _ in range(n)]
    return rows + [(None, "en", "s9"), ("", "fr", "only"), ("solo words", "fr", None), ("a " * 50_000, "en", "s2")] + [("ab abc", "en", "s1")] * 200


def test_as_by_definition(spark, monkeypatch):
    rows = fixture(1)
    want = slow(rows, 5)
    assert run(spark, rows, least=5) == want
    for name, value in (("BLOCK_SOURCES", 2), ("JOB_SUMS", 500), ("LEAVES", 3), ("MOST_COUNTERS", 40), ("WORDS", 30), ("RANGE_COUNTERS", 20)):
        monkeypatch.setattr(divergence, name, value)
    assert run(spark, rows, least=5, ranks=3) == slow(rows, 5, 3)


def test_nothing_kept_and_empty(spark):
    rows = [("a b", "en", "s1"), ("a", "en", "s2"), ("c", "en", None), ("d", None, None)]
    got = run(spark, rows)
    assert got == slow(rows, 30) and len(got) == 6 and all(r[4] == 0 for r in got)
    assert run(spark, []) == []


@pytest.mark.parametrize("seed", range(4))
def test_trie_holds_what_was_added(seed):
    rng = random.Random(seed)
    trie, want, documents = divergence.Trie(), {}, Counter()
    for _ in range(40):
        words = list({bytes(rng.choices(b"ab\xc3\xa9", k=rng.randrange(0, 7))) for _ in range(60)})
        at = np.array([rng.randrange(len(words)) for _ in range(90)])
        sources, counts, docs = np.array([rng.randrange(3) for _ in at]), np.array([rng.randrange(1, 9) for _ in at]), np.array([rng.randrange(5) for _ in words])
        trie.add(pa.array(words, pa.binary()), at, sources, counts, docs)
        for i, s, c in zip(at, sources, counts):
            want[words[i], s] = want.get((words[i], s), 0) + c
        documents.update(dict(zip(words, docs.tolist())))
    term = {leaf: t for t, leaf in trie.walk()}
    assert [t for t, _ in trie.walk()] == sorted(documents) and {t: trie.docs[i] for i, t in term.items()} == documents
    assert {(term[i], s): c for i, s, c in trie.parts[0].T} == want and trie.counters == len(want)
    assert all(not children or len(children) > 1 or leaf is not None or not label for label, children, leaf in nodes(trie.root))


def nodes(node):
    yield node
    for child in (node[1] or {}).values():
        yield from nodes(child)


def test_shared_bytes():
    words = sorted([b"", b"a", b"ab", b"abc", b"abd", b"b", b"ba" * 50, b"ba" * 50 + b"x", b"\xc3\xa9"])
    want = [0] + [len(os.path.commonprefix([a, b])) for a, b in zip(words, words[1:])]
    assert divergence.shared_bytes(pa.array([b"skip", *words], pa.binary()).slice(1)).tolist() == want
    assert divergence.shared_bytes(pa.array([], pa.binary())).tolist() == []


def test_shares_of_large_counts():
    whole = (1 << 59) - 7
    counts = np.array([0, 17, whole // 3, whole - 5])
    assert divergence.shares(counts, np.int64(whole)).tolist() == [1 + 10**9 * (int(c) + 5) // whole for c in counts]


def test_query_equals_its_sql(spark):
    from tidemark.llm.queries import ORACLES, QUERIES

    duck = duckdb.connect()
    duck.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = sorted(duck.sql(f"SELECT lang, source, part, item, value, rank FROM ({ORACLES['op13_divergence']})").fetchall())
    got = QUERIES["op13_divergence"](spark, "/root/testdata/sf0.01")
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 1000
