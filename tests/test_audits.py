"""Evidence of broken lines, re-audits that write changes only, cascades over the store's tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.operators import audits as A
from tidemark.operators import cascades as C
from tidemark.operators import documents as D
from tidemark.sources.files import Store

SPACED = "  C ô n g t y c ổ p h ầ n V i ệ t  "
GARBLED = "h0i đồng qu4n trị " + "x" * 150


def evidence(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    return [r[0] for r in A.with_evidence(D.quality(df), **options).orderBy("i").select("quality_evidence").collect()]


def test_evidence_names_the_first_lines_of_each_rule(spark):
    lines = ["# report", SPACED, "fine\u2028" + GARBLED, ""] + [f"dòng b{i}c và b{i}c d{i}e" for i in range(8)] + [SPACED, "between them", SPACED]
    got = evidence(spark, ["\n".join(lines), "all is well here", None, ""])
    spaced, garbled = got[0].split(" || ")
    assert spaced.startswith("broken_spacing=L2: C ô n g t y c ổ p h ầ n V i ệ t | C ô n g") and [x.split(":")[0] for x in spaced.split(" ; ")] == ["broken_spacing=L2", "L14", "L16"]
    parts = garbled.removeprefix("garbled=").split(" ; ")
    assert [p.split(":")[0] for p in parts] == ["L4", "L6", "L7", "L8", "L9"]
    assert parts[0] == "L4: h0i, qu4n | " + GARBLED[:117] + "..." and parts[1] == "L6: b0c, d0e | dòng b0c và b0c d0e"
    assert got[1:] == ["", "", ""]
    one = evidence(spark, [SPACED + "\n" + "lorem ipsum " * 200])[0]
    assert one == "" and evidence(spark, [SPACED + "\n" + "lorem ipsum " * 200], all_rules=True)[0].startswith("broken_spacing=L1: ")


def test_long_runs_of_letters(spark):
    import re

    old = re.compile(rf"\b(?:[{D.LETTER}]\s+){{3,}}[{D.LETTER}]\b")
    texts = ["T h i s " * 60_000, "a b c d", "a b c dd", "xa b c d e", "a b cc d e f g", "đ ặ c b i ệ t, x y z t u", "a  b\nc\td e1 f", "a b c d-e f g h"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.regexp_extract_all("t", F.lit(D.BROKEN_SPACING), 1)).collect()
    assert [r[0] for r in got] == [old.findall(t) for t in texts]


def reports(spark, tmp_path):
    rows = [("AAA", y, t, f"m/{y}/{i}.md") for y in (2020, 2021, 2022) for i, t in enumerate(["good text " * 30, "bad<br>w0rd b1d\n" * 3, "\nlines between\n".join([SPACED] * 4)])]
    df = spark.createDataFrame([(f"T{i}", *r[1:]) for i, r in enumerate(rows)], "ticker string, year int, content string, source_file string")
    path = str(tmp_path / "reports")
    schema.evolved(df, "annual_reports").write.partitionBy("year").parquet(path)
    return path


def files(path):
    return sorted((os.path.join(d, f), os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_a_reaudit_writes_only_changed_partitions(spark, tmp_path):
    path = reports(spark, tmp_path)
    first = A.reaudit(spark, path, ["ticker", "year"])
    assert {k: first[k] for k in ("checked", "changed", "partitions")} == {"checked": 9, "changed": 9, "partitions": 3}
    assert first["flagged"] == first["warnings"] + first["failed"] == 6
    stored = spark.read.parquet(path)
    assert stored.count() == 9 and stored.where("quality_checked_at IS NULL OR content LIKE '%<br>%'").isEmpty()
    assert stored.where("quality_suspicious").count() == 6 and stored.where("quality_evidence <> ''").count() == 6
    before = files(path)
    again = A.reaudit(spark, path, ["ticker", "year"])
    assert again == {**first, "changed": 0, "partitions": 0} and files(path) == before
    times = {r.ticker: r.quality_checked_at for r in stored.collect()}
    source = spark.createDataFrame([("m/2021/0.md", "now b1d w0rds h3re"), ("elsewhere.md", "x")], "source_file string, content string")
    third = A.reaudit(spark, path, ["ticker", "year"], sources=source)
    assert (third["changed"], third["partitions"], third["flagged"]) == (1, 1, 7)
    now = spark.read.parquet(path)
    assert [r.ticker for r in now.collect() if r.quality_checked_at != times[r.ticker]] == ["T3"]
    assert {f for f, _ in files(path)} ^ {f for f, _ in before} and [f for f, _ in files(path) if "2021" not in f] == [f for f, _ in before if "2021" not in f]
    one = A.reaudit(spark, path, ["ticker", "year"], only=F.col("ticker") == "T8")
    assert one["checked"] == 1 and spark.read.parquet(path).count() == 9


def test_deleting_firms_leaves_what_must_stay(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for table in [r.table for r in C.FIRM] + ["document_embeddings"]:
        column = C.FIRM_COLUMN.get(table, "ticker")
        rows = spark.createDataFrame([("AAA",), ("AAA",), ("BBB",), (None,)], f"{column} string")
        store.write(table, schema.evolved(rows, table))
    counts = C.delete_companies(store, spark.createDataFrame([("aaa",), ("AAA",), (None,), ("ZZZ",)], "ticker string"))
    assert counts == {r.table: (2, 4) for r in C.FIRM} and len(counts) == 12
    for table in counts:
        assert sorted(str(r[0]) for r in store.read(table).select(C.FIRM_COLUMN.get(table, "ticker")).collect()) == ["BBB", "None"]
    assert store.read("document_embeddings").count() == 4 and store._latest("document_embeddings")[0] == 1


def test_a_reset_starts_from_the_source_file(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    years = [("AAA", 2020), ("AAA", 2021), ("BBB", 2020), ("CCC", 2020)]
    for table in [r.table for r in C.DOWNSTREAM]:
        rows = spark.createDataFrame(years, "ticker string, year int").withColumns({"status": F.lit("completed"), "batch_id": F.lit("b"), "error_message": F.lit("e"), "categories_done": F.lit(5), "color": F.lit("Gold")})
        store.write(table, schema.evolved(rows, table))
    jobs = spark.createDataFrame([(7, "AAA", 2020, "raw/a.pdf", "failed", "boom"), (8, "BBB", 2020, "", "completed", None)], "id int, ticker string, year int, source_path string, status string, error_message string")
    store.write("conversion_jobs", schema.evolved(jobs, "conversion_jobs"))
    docs = [(1, "BBB", "Báo cáo 2020", True, "raw/old.pdf", "2020-01-01"), (2, "BBB", "Báo cáo 2020", True, "raw/new.pdf", "2021-01-01"), (3, "CCC", "Báo cáo 2020", False, "raw/c.pdf", "2021-01-01"), (4, "AAA", "2021", True, "", "2021-01-01")]
    store.write("listed_documents", schema.evolved(spark.createDataFrame(docs, "id long, ticker string, title string, synced_to_raw boolean, raw_path string, published_date string"), "listed_documents"))
    asked = spark.createDataFrame([("aaa", 2020), ("BBB", 2020), ("CCC", 2020), ("AAA", 2021), (None, 2020), ("DDD", None)], "ticker string, year int")
    counts, lost = C.reset_downstream(store, asked, "by hand")
    assert sorted(map(tuple, lost.collect())) == [("AAA", 2021), ("CCC", 2020)]
    assert counts == {r.table: (2, 4) for r in C.DOWNSTREAM}
    assert store.read("annual_reports").count() == 2
    got = {(r.ticker, r.year): (r.status, r.batch_id, r.error_message, r.color) for r in store.read("proper_vn_jobs").collect()}
    assert got["AAA", 2020] == ("pending", None, None, None) and got["CCC", 2020] == ("completed", "b", "e", "Gold")
    assert {r.categories_done for r in store.read("inference_jobs").where("ticker = 'BBB'").collect()} == {0}
    jobs = {r.ticker: r for r in store.read("conversion_jobs").collect()}
    assert (jobs["AAA"].id, jobs["AAA"].source_path, jobs["AAA"].status, jobs["AAA"].error_message, jobs["AAA"].rerun_reason) == (7, "raw/a.pdf", "pending", None, "by hand")
    assert (jobs["BBB"].id, jobs["BBB"].source_path, jobs["BBB"].start_year) == (8, "raw/new.pdf", 2020) and len(jobs) == 2


def test_rules_keep_rows_with_null_keys(spark):
    rows = spark.createDataFrame([(None, 1), ("A", None), ("A", 1)], "ticker string, year int")
    left = C.after(rows, spark.createDataFrame([("A", 1), (None, 1)], "ticker string, year int"), C.Rule("t", (("ticker", "ticker"), ("year", "year"))))
    assert sorted(map(str, left.collect())) == sorted(map(str, rows.collect()[:2]))


@pytest.mark.parametrize("line, want", [("  a ", "a"), ("x" * 120, "x" * 120), ("x" * 121, "x" * 117 + "..."), ("\x1d y \x1e", "y")])
def test_snippets(spark, line, want):
    assert spark.createDataFrame([(line,)], "l string").select(A.snippet(F.col("l"))).first()[0] == want


def test_statement_audits(spark, tmp_path):
    from tidemark.sources.files import export

    long, letter = "word " * 3000, "Kính gửi: Sở giao dịch chứng khoán\n"
    texts = {"AAA": "short", "BBB": "BẢNG CÂN ĐỐI KẾ TOÁN " + letter, "CCC": long, "DDD": letter + long, "EEE": "w0rd b1d " * 40, "FFF": None}
    rows = spark.createDataFrame([(t, 2020, x, f"{t}.md") for t, x in texts.items()], "ticker string, year int, content string, source_file string")
    out = A.statement_audit(rows)
    assert out.columns == list(A.AUDIT_COLUMNS) and len(out.columns) == 23
    got = {r.ticker: r for r in out.collect()}
    assert [r.ticker for r in out.collect()][0] == "EEE" and {t: r.quality_status for t, r in got.items()} == {"AAA": "fail", "BBB": "pass", "CCC": "pass", "DDD": "fail", "EEE": "fail", "FFF": "fail"}
    assert (got["BBB"].financial_statement_section_count, got["BBB"].financial_statement_disclosure_marker_count) == (1, 2)
    assert got["AAA"].suspicious_reason == D.NOT_A_STATEMENT and got["AAA"].suspicious_score == 0.95 and got["AAA"].quality_evidence == "content_check=sections=0 disclosures=0 tokens=1"
    assert got["DDD"].quality_evidence.endswith("tokens=3007 || disclosure_markers=kinh gui,so giao dich chung khoan")
    assert got["EEE"].suspicious_reason.split(",")[-2:] == ["garbled_vietnamese_tokens", D.NOT_A_STATEMENT] and got["CCC"].suspicious is False
    export(out, str(tmp_path / "audit"), "csv")
    assert spark.read.csv(str(tmp_path / "audit"), header=True).columns == list(A.AUDIT_COLUMNS)
    scored = D.content_checks(D.quality(rows))
    assert [r.ticker for r in D.quality_reruns(scored, ["fail"], 500, 2).collect()] == ["EEE", "AAA"] and D.quality_reruns(scored, ["fail", "pass"], 500).count() == 4


def test_a_filter_on_scores_computes_them_once(spark):
    """A filter's copy of the score's expressions made texts be read many times over."""
    plan = D.suspicious_first(D.quality(spark.createDataFrame([("a b c",)], "content string")))._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count(D.BROKEN_SPACING) <= 2 and plan.count(D.TOKEN) == 1


def test_garbled_words_are_those_of_every_word(spark):
    """Words that are passed over unasked are none that the rules call garbled."""
    rng = random.Random(2)
    letters = ["a", "B", "é", "Đ", "ỹ", "1", "7", ",", ".", "/", "%", "*", "#", "(", ")", "|", "^", "=", "-", "'", "@", "_", " ", " ", "\t", " ", " ", "\x1c", "​", "\U0001f600", "ß"]
    rows = [("".join(rng.choices(letters, k=rng.randint(0, 60))),) for _ in range(3000)] + [("a1b",), ("x" * 5000 + "1" * 5000 + "y",), ("1" * 5000,)]
    df = spark.createDataFrame(rows, "t string")
    every = F.filter(F.split("t", r"(?U)\s+"), lambda w: (w != "") & D.is_garbled(w))
    got = df.select(D.garbled_words(F.col("t")).alias("a"), every.alias("b")).collect()
    assert all(r.a == r.b for r in got) and sum(map(len, (r.a for r in got))) > 500
    token = F.filter(D.tokens(F.col("t")), lambda t: F.length(t) == 1)
    scored = D.quality(df, "t").select("t", "single_char_count", "isolated_diacritic_count", F.size(token).alias("n"), F.size(F.filter(token, lambda t: t.rlike("[À-ỹ]"))).alias("d")).collect()
    assert all((r.single_char_count, r.isolated_diacritic_count) == (r.n, r.d) for r in scored)
