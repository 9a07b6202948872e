import sys

import pytest

from tidemark.llm import secret_scan, sentence_piece
from tidemark.llm.common import settle


@pytest.fixture(scope="module")
def pipeline():
    import corpus_pipeline

    return corpus_pipeline


def rows():
    import random

    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n)).capitalize() + "."
    good = [(i, text(rng.randint(60, 200)), "en", f"s{i % 3}", None) for i in range(120)]
    copies = [(500 + i, good[3][1], "en", "s0", None) for i in range(10)]
    return good + copies + [(600, "too short", "en", "s1", None), (601, None, None, None, None), (602, good[4][1] + " token = abcdefgh1234", "en", "s1", 5), (603, text(80).replace(" ", "### "), "en", "s1", None)]


def test_stages_against_their_parts(spark, pipeline):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "sentence_piece"]
    now = docs
    out = {}
    for name, stage in pipeline.STAGES:
        now = settle(stage(spark, now, ""))
        out[name] = now.collect()
        if name != "sentence_piece":
            assert now.columns == docs.columns
    ids = {r.doc_id for r in out["quality"]}
    assert set(range(120)) <= ids and not ids & {600, 601, 603}
    ids = {r.doc_id for r in out["near_duplicates"]}
    assert set(range(120)) - ids <= set() and not ids & set(range(500, 510))
    secret = [r for r in out["secrets"] if r.doc_id == 602]
    assert len(secret) <= 1 and all(r.text.endswith("[SECRET]") and r.n_chars == len(r.text) for r in secret)
    assert {r.doc_id: r.text for r in out["secrets"]} == {r.doc_id: secret_scan.masked(r.text) for r in out["near_duplicates"]}
    kept = {r.doc_id: r.text for r in out["secrets"]}
    assert all(kept[r.doc_id] == r.text for r in out["mixing"])
    own = sentence_piece.transducer(sentence_piece.MODEL)
    assert sorted((r.doc_id, r.ids) for r in out["sentence_piece"]) == sorted((r.doc_id, own.encode(r.text)) for r in out["mixing"])


def test_empty_table(spark, pipeline):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        docs = settle(stage(spark, docs, ""))
        assert docs.count() == 0
