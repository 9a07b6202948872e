import random

import numpy as np
import xxhash

from tidemark.llm import simhash


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(keys, budget=2):
    label = list(range(len(keys)))
    changed = True
    while changed:
        changed = False
        for i in range(len(keys)):
            for j in range(len(keys)):
                if (keys[i] ^ keys[j]).bit_count() <= budget and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprint():
    for text in ["", " \t\n", "One", "one TWO", "a b c", "ÄÖ ß x y z y x", "w " * 5000, "a b c\x0bd e\x85f g"]:
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_trie_classes_match_all_pairs():
    rng = random.Random(1)
    for n, hubs in ((60, 3), (150, 10), (1, 1)):
        centres = [rng.getrandbits(64) for _ in range(hubs)]
        keys = {rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(n)}
        keys = np.array(sorted(keys), np.uint64)
        got = simhash.trie_classes(keys, 0, 2, leaf=2)
        assert got.tolist() == slow_classes([int(k) for k in keys])


def test_near_duplicates_with_deeper_pairs(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(rng.randint(0, 60))) for _ in range(25)]
    rows = [(i, (t := rng.choice(base)) + (" x" if rng.random() < 0.3 else "")) for i in range(70)]
    rows += [(70, None), (71, ""), (72, " "), (73, "w " * 9000), (73, "w " * 9000), (None, rows[0][1]), (None, "quite alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as fp", "1 as component_id", "2 as root")
    keys = sorted({slow_fingerprint(t or "") for _, t in rows})
    label = slow_classes(keys)
    cls = dict(zip(keys, label))
    least = {}
    for i, t in rows:
        c = cls[slow_fingerprint(t or "")]
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    want = sorted(((i, slow_fingerprint(t or ""), least[cls[slow_fingerprint(t or "")]]) for i, t in rows), key=str)
    for largest in (simhash.LARGEST_PAIR, 3):
        got = simhash.near_duplicates(docs, largest=largest).collect()
        assert sorted(((r[0], r[1] % 2**64, r[2]) for r in got), key=str) == want
    kept = simhash.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({v for v in least.values() if v is not None})
    assert simhash.keep_one(docs).columns == docs.columns


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0
