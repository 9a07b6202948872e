import random
import re

import numpy as np

from tidemark.llm import quality


def slow_counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again))


def slow_estimate(x, starts=60):
    """A minimum covariance determinant by brute force: many random starts, each iterated until it is still."""
    floors = np.array([quality.SCALE * f for f in quality.FLOORS.values()])
    rng = np.random.default_rng(4)

    def estimate(part, factor=1.0):
        return part.mean(0), factor * np.cov(part.T, bias=True) + np.diag(floors**2)

    def distances(centre, cov):
        return np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)

    def half(centre, cov):
        rank = np.floor(200 * np.log1p(distances(centre, cov)))
        return x[rank <= np.median(rank)]

    best, best_is_half = None, False
    for _ in range(starts):
        now = estimate(x[rng.choice(len(x), 8, replace=False)])
        while True:
            after = estimate(half(*now))
            if np.linalg.slogdet(after[1])[1] >= np.linalg.slogdet(now[1])[1] - 1e-9 and best_is_half:
                break
            now, best_is_half = after, True
        best_is_half = False
        if best is None or np.linalg.slogdet(now[1])[1] < np.linalg.slogdet(best[1])[1]:
            best = now
    raw = estimate(half(*best), quality.HALF_FACTOR)
    centre, cov = estimate(x[distances(*raw) <= quality.WITHIN], quality.WITHIN_FACTOR)
    return np.linalg.slogdet(best[1])[1], lambda v: np.einsum("ij,jk,ik->i", v - centre, np.linalg.inv(cov), v - centre)


def corpus():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 9))) for _ in range(500)]
    rows = []
    for i in range(240):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(20, 300))).capitalize() + "."
        if i % 20 == 0:
            text = re.sub(" ", "### ", text)
        if i % 20 == 1:
            text = text.upper().replace(" ", "!! ")
        if i % 20 == 2:
            text = "same words here " * 40
        rows.append((i, text, ["en", "fr"][i % 2], ["s1", "s2", None][i // 2 % 3]))
    rows += [(300 + i, rows[5][1], "en", "s1") for i in range(200)]  # copies
    rows += [(600, None, "en", "s1"), (601, "", None, None), (602, "\n \n\x0b", "en", "s2"), (603, "l x\nl x\n\nl x\r\nl x", "en", "s1"), (5, *rows[5][1:])]
    return rows


def test_counts_and_verdicts(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as kept", "2 as d2")
    got = [r.asDict() for r in quality.rate(docs).collect()]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted((r["doc_id"], *[r[n] for n in names]) for r in got) == sorted((r[0], *slow_counts(r[1])) for r in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    junk = {i for i in range(240) if i % 20 in (0, 1)}
    for r in got:
        if not r["base_failed"]:
            assert r["kept"] == (r["doc_id"] not in junk), r
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.keep_good(docs).count() == sum(r["kept"] for r in got)


def test_distances_match_a_plain_estimate(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    counted = quality.with_counts(quality._prepared(docs)).cache()
    vectors = counted.where("not q_base_failed").select("q_own", "q_lang", *quality.DIMS).distinct().toPandas()
    got = quality.verdicts(counted).select("row.doc_id", "q_own", "q_base_failed", "q_d2", *quality.DIMS).toPandas()
    checked = same = 0
    for own, part in vectors.groupby("q_own"):
        if len(part) < quality.LEAST_VECTORS:
            part = vectors[vectors.q_lang == part.q_lang.iloc[0]].drop_duplicates(quality.DIMS)
        if len(part) < quality.LEAST_VECTORS:
            continue
        _, distances = slow_estimate(part[quality.DIMS].to_numpy(float))
        mine = got[(got.q_own == own)]
        want = distances(mine[quality.DIMS].to_numpy(float))
        same += np.isclose(want, mine.q_d2, rtol=1e-6).sum()
        assert ((want <= quality.CUTOFF) == (mine.q_d2 <= quality.CUTOFF)).all()
        checked += len(mine)
    assert checked > 200 and same > 0.7 * checked, (same, checked)


def test_every_column_comes_back(spark):
    """Columns named like internal ones keep their values, and repeated and null ids their rows."""
    names = ["d2", "q_length", "q_words", "q_text", "m_0", "row", "rank", "half", "q_start", "log_det", "n", "count", "q_own", "kept"]
    rows = [(*r, *[f"{n}{i}" for n in names]) for i, r in enumerate(corpus()[:60] + [(7, *corpus()[7][1:]), (None, *corpus()[8][1:])])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    good = {(r.doc_id, r.text) for r in quality.rate(docs).join(docs.select("doc_id", "text"), "doc_id").where("kept").collect()} | {(None, rows[-1][1])}
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(str(r) for r in rows if (r[0], r[1]) in good)


def test_lone_extremes_are_rejected(spark):
    rng = random.Random(8)
    words = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**4)}" for _ in range(n)]
    rows = [(i, " ".join(words(150)), "en", "s") for i in range(80)]
    own = words(150)
    rows.append((900, " ".join(own[:30] * 2 + own[30:] ), "en", "s"))  # a third repeated
    rows.append((901, " ".join(own[:33] * 2 + own[33:111]), "en", "s"))  # just under the base rule
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.rate(docs).collect()}
    assert got[901] == (False, False) and all(got[i] == (False, True) for i in range(80))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality.rate(docs).count() == 0 and quality.keep_good(docs).count() == 0
