"""Paged listings and cached query vectors against stub sites and providers."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidemark.operators import query_cache as Q
from tidemark.sources import listing as L
from tidemark.sources.files import Store

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't see this folder


def said(folder, what):
    """Workers run in other processes, so what they asked is told by files."""
    import os
    import uuid

    with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
        json.dump(what, f)


def asked(folder):
    return sorted((json.loads(p.read_text()) for p in folder.iterdir()), key=str)


def clear(folder):
    for p in folder.iterdir():
        p.unlink()


def site(log, broken=()):
    """AAA has 45 documents, BBB an object with one list, CCC nothing, DDD fails on page 2, EEE ends early."""

    def fetch(code, doc_type, year, page):
        said(log, [code, year, page])
        if (code, page) in broken:
            raise TimeoutError("timed out")
        if code in ("AAA", "DDD"):
            return json.dumps([{"DocumentID": 100 * page + i, "Title": f"Báo cáo thường niên năm {2018 + page}", "FileInfoID": i % 12 + page, "TotalRow": "45"} for i in range(20 if page < 3 else 5)])
        if code == "BBB":
            return json.dumps({"Total": 2, "None": [], "Data": [{"id": 7, "r_title": "x", "Url": "/a"}, {"ID": 8, "Title": "y"}]})
        if code == "EEE":
            return json.dumps([{"id": page, "Title": f"t{page}", "TotalRow": 200}]) if page < 3 or page > 5 else "  "
        return "<html>" if code == "CCC" else json.dumps({"id": 9, "Title": "BCTC kiểm toán năm", "FileURL": "f"})

    return fetch


def test_pages_are_planned_landed_and_resumed(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    store = Store(spark, str(tmp_path / "store"))
    wanted = spark.createDataFrame([(c, "2", None) for c in ("AAA", "BBB", "CCC", "DDD", "EEE")] + [("FFF", "1", 2020)], L.REQUEST)
    pages = L.land(store, wanted, site(str(log), broken={("DDD", 2)}), "r1")
    assert [a for a in asked(log) if a[0] in "AAA BBB CCC DDD"] == [["AAA", None, 1], ["AAA", None, 2], ["AAA", None, 3], ["BBB", None, 1], ["CCC", None, 1], ["DDD", None, 1], ["DDD", None, 2], ["DDD", None, 3]]
    found = L.documents(pages)
    told = {r.ticker: (r.n_saved, r.error) for r in L.progress(pages, found).collect()}
    assert told == {"AAA": (13, None), "BBB": (2, None), "CCC": (0, None), "DDD": (0, "timed out"), "EEE": (2, None), "FFF": (1, None)}
    firsts = {r.file_info_id: r.id for r in found.where("ticker = 'AAA'").collect()}
    assert firsts == {**{i + 1: 100 + i for i in range(12)}, 13: 211}
    assert {(r.id, r.title, r.file_url) for r in found.where("ticker in ('BBB', 'FFF')").collect()} == {(7, "x", "/a"), (8, "y", ""), (9, "BCTC kiểm toán năm", "f")}
    assert L.documents(pages, 2020, 2020).where("ticker = 'AAA'").count() == 1 and L.documents(pages, 2020, 2020).where("ticker = 'EEE'").count() == 2
    clear(log)
    pages = L.land(store, wanted, site(str(log)), "r1")
    assert asked(log) == [["DDD", None, 2]]  # only what had failed
    assert L.documents(pages).where("ticker = 'DDD'").count() == 13 and pages.where("error IS NOT NULL").isEmpty()
    clear(log)
    L.land(store, wanted, site(str(log)), "r1")
    assert asked(log) == []


def test_listing_as_a_data_source(spark, tmp_path):
    spark.dataSource.register(L.listing_source(site(str(tmp_path))))
    read = lambda code: spark.read.format("paged_listing").option("code", code).load()
    got = read("AAA").select("page", F.size(L.items(F.col("answer"))).alias("n")).collect()
    assert sorted(map(tuple, got)) == [(1, 20), (2, 20), (3, 5)]
    assert read("AAA").rdd.getNumPartitions() == 3 and read("BBB").count() == 1 and read("CCC").count() == 1


def test_saved_rows_take_the_place_of_the_same_file(spark):
    known = spark.createDataFrame([(1, "AAA", "2", "old", 5, True), (2, "AAA", "2", "other", 6, False), (3, "BBB", "2", "b", None, False)], "id long, ticker string, doc_type string, title string, file_info_id long, synced_to_raw boolean")
    rows = [(9, "AAA", "2", "new", 5, 1), (2, "AAA", "2", "moved", 7, 2), (3, "BBB", "2", "b1", 8, 3), (3, "BBB", "2", "b2", 9, 4), (4, "CCC", "2", "c", None, 5)]
    found = spark.createDataFrame(rows, "id long, ticker string, doc_type string, title string, file_info_id long, place int").selectExpr("*", "'' as full_name", "'' as source", "'' as published_date", "'' as file_url")
    got = sorted(tuple(r) for r in L.saved(known, found).collect())
    assert got == [(1, "AAA", "2", "new", 5, True), (2, "AAA", "2", "moved", 7, False), (3, "BBB", "2", "b2", 9, False), (4, "CCC", "2", "c", None, None)]


def providers(log, broken=()):
    def hypothesise(criteria, model, n):
        said(log, ["hypothesise", sorted(criteria)])
        if set(criteria) & set(broken):
            raise RuntimeError("refused")
        return [[f"{c} {i}" for i in range(n)] for c in criteria]

    def embed(texts, model, dimensions):
        said(log, ["embed", sorted(texts)])
        return [[float(len(t))] * dimensions for t in texts]

    return hypothesise, embed


def test_a_second_run_asks_nothing(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    store = Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("board",), (" board ",), ("audit firm",), ("",), (None,), ("bad",)], "text string")
    ask = lambda how, model="m": {r.criterion: (r.origin, r.vector) for r in Q.cached_vectors(store, Q.requests(rows, "text", "e", 3, model), *how).collect()}
    want = {"board": [(5 + 7 + 7) / 3] * 3, "audit firm": [(10 + 12 + 12) / 3] * 3, "bad": [3.0] * 3}
    got = ask(providers(str(log), broken={"bad"}))
    assert {c: o for c, (o, _) in got.items()} == {"board": "new", "audit firm": "new", "bad": "plain"}
    assert all(v == pytest.approx(want[c]) for c, (_, v) in got.items())
    assert not [a for a in asked(log) if a[0] == "embed" and "bad 0" in a[1]]
    clear(log)
    got = ask(providers(str(log), broken={"bad"}))  # only the refused one is asked for again
    assert {c: o for c, (o, _) in got.items()} == {"board": "cache", "audit firm": "cache", "bad": "plain"}
    assert asked(log) == [["embed", ["bad"]], ["hypothesise", ["bad"]]]
    clear(log)
    assert ask(providers(str(log)))["bad"] == ("new", pytest.approx([(3 + 5 + 5) / 3] * 3))
    clear(log)
    assert {o for o, _ in ask(providers(str(log))).values()} == {"cache"} and asked(log) == []
    versions = store._latest("query_vectors")[0]
    assert versions == 3 and {o for o, _ in ask(providers(str(log)), "other").values()} == {"new"}  # another key


def test_hypotheses_are_shared_by_embedding_models(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    store = Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("a b",), ("c",)], "text string")
    for model in ("e1", "e2"):
        Q.cached_vectors(store, Q.requests(rows, "text", model, 2, "m"), *providers(str(log))).collect()
    assert sum(len(a[1]) for a in asked(log) if a[0] == "hypothesise") == 2
    assert Q.cached_vectors(store, Q.requests(rows.limit(0), "text", "e", 2, "m"), *providers(str(log))).count() == 0
