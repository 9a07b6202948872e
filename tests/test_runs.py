"""Model runs, presets, syncs, downloads and audit orders on cases with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import documents as D
from tidemark.operators import runs as M
from tidemark.operators import state as U


def _value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def _chunks(spark, rows):
    return spark.createDataFrame(rows, "ticker string, year int, chunk_index int, chunk_text string, chunk_metadata_json string")


def test_batches_stay_within_a_firm_year(spark):
    rows = [("A", 2020, i, "x", None) for i in range(10)] + [("B", 2020, 0, "x", " "), ("B", 2021, 0, "x", "{}")]
    got = M.submitted(M.chosen_chunks(_chunks(spark, rows)), "r", 4).collect()
    assert {(r.ticker, r.chunk_index, r.batch_id) for r in got} == {("A", i, f"r-A-2020-{i // 4}") for i in range(10)} | {("B", 0, "r-B-2020-0")}
    assert len({r.custom_id for r in got}) == 11


def test_backfill_keeps_metadata_and_reads_null_texts(spark):
    rows = [("A", 2020, 0, "# Heading", None), ("A", 2020, 1, None, ""), ("A", 2020, 2, "x", '{"a":1}')]
    got = {r.chunk_index: r.chunk_metadata_json for r in M.backfilled(_chunks(spark, rows)).collect()}
    assert json.loads(got[0])["heading_hints"] == ["# Heading"] and json.loads(got[1])["section_tags"] == [] and got[2] == '{"a":1}'


def test_regeneration_falls_back_to_rules(spark):
    def provider(texts):
        if any("fail" in t for t in texts):
            raise RuntimeError("no answer")
        return [json.dumps({"section_tags": ["audit_report"], "summary": "s"}) if t == "good" else "not json" for t in texts]

    rows = [("A", 2020, 0, "good", None), ("A", 2020, 1, "odd", None), ("A", 2020, 2, "fail", None), ("A", 2020, 3, None, None)]
    got = {r.chunk_index: json.loads(r.chunk_metadata_json) for r in M.regenerated(_chunks(spark, rows), provider, 1).collect()}
    assert got[0]["metadata_source"] == "hybrid" and got[0]["section_tags"] == ["audit_report"]
    assert [got[i]["metadata_source"] for i in (1, 2, 3)] == ["deterministic"] * 3


def test_presets(spark):
    old = spark.sql("SELECT 'inference' AS task_type, 'a' AS model_name, false AS is_active, TIMESTAMP_NTZ'2020-01-01' AS created_at")
    new = M.with_presets(old, "inference", [" a ", "b"])
    assert {(r.model_name, r.is_active, r.created_at is None) for r in new.collect()} == {("a", True, False), ("b", True, True)}
    with pytest.raises(ValueError):
        M.with_presets(old, "inference", [" "])


@pytest.mark.parametrize("sizes, needs", [([], None), ([99], True), ([100], False), ([100] * 4 + [0], True), ([150, 0] * 5, False), ([0, 150] * 5, True)])
def test_ocr_by_evenly_spaced_pages(spark, sizes, needs):
    pages = spark.createDataFrame([("d", i, " " + "x" * n + "\n") for i, n in enumerate(sizes)], "doc string, page int, text string")
    got = [r.needs_ocr for r in D.needs_ocr(pages, "doc", "page", "text").collect()]
    assert got == ([] if needs is None else [needs])


def test_best_statement_file(spark):
    files = [("Bao cao tai chinh quy 1.pdf", 900, "q"), ("Bao cao tai chinh hop nhat kiem toan.pdf", 10, "best"), ("Bao cao tai chinh kiem toan.pdf", 500, "own"), ("Thuyet minh.pdf", None, "note")]
    df = spark.createDataFrame([("A", *f) for f in files], "ticker string, name string, size long, path string")
    assert D.statement_source(df, ["ticker"]).first()["path"] == "best"


def test_audit_and_suspicious_orders(spark):
    rows = [("pass", 9, 0.1, 0.9, "A"), ("fail", 1, 0.1, 0.2, "B"), ("fail", 2, 0.1, 0.3, "C"), ("warning", 9, 0.2, 0.5, "D"), (None, 0, 0.0, 0.45, "E")]
    df = spark.createDataFrame(rows, "quality_status string, garbled_count int, garbled_ratio double, suspicious_score double, ticker string")
    df = df.withColumns({"year": F.lit(2020), "broken_spacing_count": F.col("garbled_count"), "single_char_ratio": F.lit(0.0)})
    assert [r.ticker for r in D.audit_order(df).collect()] == ["C", "B", "D", "A", "E"]
    assert [r.ticker for r in D.suspicious_first(df).collect()] == ["A", "D", "E"]


def test_download_addresses(spark):
    base = "https://h.example/"
    find = lambda t, title, p: _value(spark, X.download_candidates(F.lit(t), F.lit(title), F.lit(p), base))
    assert find("a", "BCTC 2020", "/data/x.pdf") == [base + "x.pdf"]
    assert find("a", "no year", "x") == [base + "x"] and find(None, "2020", "x") == [base + "x"]
    assert find(" a ", "BCTC 2020", "x/")[:3] == [base + "x/", base + "x/A_Baocaotaichinh_2020_Kiemtoan.pdf", base + "x/A_Baocaotaichinh_2020_Kiemtoan.zip"]
    assert len(find("a", "BCTC hợp nhất 2020", "x")) == 9
    assert _value(spark, X.download_url(F.lit(None).cast("string"), base)) == ""


def test_language_and_framework(spark):
    assert _value(spark, X.language_score(F.lit("d/VI_Bao_cao.pdf"))) == 12
    assert _value(spark, X.language_score(F.lit("vietnamese/EN-report.pdf"))) == -11
    assert _value(spark, X.framework_name(F.lit(" proper-vn"))) == "PROPER_VN" and _value(spark, X.framework_name(F.lit(None).cast("string"))) is None
    with pytest.raises(Exception, match="unknown framework"):
        _value(spark, X.framework_name(F.lit("other")))


def test_syncs(spark):
    firms = spark.createDataFrame([("A",), ("B",), (None,)], "code string")
    stored = spark.createDataFrame([("A",), ("A",)], "code string")
    assert {r.code for r in U.sync_targets(firms, stored).collect()} == {"B", None} and U.sync_targets(firms, stored, force=True).count() == 3
    assert U.sync_requests(firms, 2020, 2022).count() == 9 and U.sync_requests(firms, 2022, 2020).count() == 0


def test_items_of_a_task():
    known = {"edc": [{"code": "CC1", "description": "d"}]}
    assert M.task_items("edc", None, known) == known["edc"]
    assert M.task_items("edc", [{"code": " A ", "description": "b ", "x": 1}], known) == [{"code": "A", "description": "b", "x": 1}]
    for bad in (("other", None), ("edc", [{"code": "A", "description": " "}]), ("edc", [{"description": "x"}])):
        with pytest.raises(ValueError):
            M.task_items(*bad, known)
    assert M.plain_codes(["GOV_BOARD", "X"], {"GOV_BOARD": "GOV_DIRECTORY"}) == ["GOV_DIRECTORY", "X"]
