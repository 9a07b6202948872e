"""Cases with known answers: rosters, audits, quality, state, sources, console, streams."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.console import Console, guard
from tidemark.functions import text as X
from tidemark.functions.vector import guarded_similarity
from tidemark.operators import dashboards as D
from tidemark.operators import documents as Q
from tidemark.operators import retrieval as R
from tidemark.operators import scoring as S
from tidemark.operators import state as U
from tidemark.sources import files, milestones, rest


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_company_sync(spark):
    stocks = spark.createDataFrame([("AAA", "HOSE"), ("BBB", "HNX"), ("CCC", "HOSE")], "code string, floor string")
    none = spark.createDataFrame([], "ticker string")
    for floors, want, tickers in ((None, (3, 3, 0), "ABC"), (["HOSE"], (2, 2, 0), "AC")):
        companies, report = D.company_sync(stocks, none, floors)
        assert tuple(report.first()) == want
        assert sorted(r.ticker for r in companies.collect()) == [c * 3 for c in tickers]


def test_audit_answers(spark):
    first = {"found": False, "details": [{"type": "firm", "name": "Deloitte Vietnam", "evidence": "Công ty kiểm toán Deloitte Việt Nam"}, {"type": "opinion", "opinion": "chấp nhận toàn phần"}]}
    second = {"found": False, "details": []}
    rows = [("A", 1, json.dumps(first), "Báo cáo kiểm toán độc lập ..."), ("B", 1, json.dumps(second), "Ý kiến của kiểm toán viên: chấp nhận toàn phần về báo cáo tài chính"), ("C", 1, "broken", None), ("D", 1, json.dumps({"details": [{"name": "Công ty TNHH KPMG Limited"}]}), "")]
    got = {r.ticker: r for r in S.audit_normalized(spark.createDataFrame(rows, "ticker string, year int, answer string, source_text string")).collect()}
    assert (got["A"].found, got["A"].external_audit_firm, got["A"].audit_opinion) == (True, "Deloitte Vietnam", "unqualified")
    assert (got["B"].found, got["B"].external_audit_firm, got["B"].audit_opinion) == (True, None, "unqualified")
    assert (got["C"].found, got["D"].external_audit_firm) == (False, "KPMG")
    refused = spark.createDataFrame([("E", 1999, "{}", "công ty từ chối"), ("F", 1999, None, None), ("G", 1999, '{"found": true, "signing_auditor_names": ["H"], "details": []}', "")], "ticker string, year int, answer string, source_text string")
    got = {r.ticker: r for r in S.audit_normalized(refused).collect()}
    assert (got["E"].audit_opinion, got["F"].found, got["G"].found, got["G"].signing_auditor_names) == ("disclaimer", False, True, ["H"])


def test_statement_rosters(spark):
    code = S.stored_code(F.col("c"), F.col("t"))
    assert one(spark, code, c="GOV_DIRECTORY", t="financial_statement_document_embeddings") == "GOV_DIRECTORY_FS"
    assert one(spark, code, c="GOV_DIRECTORY", t="document_embeddings") == "GOV_DIRECTORY"
    details = json.dumps([{"name": "Nguyễn Thị A", "position": "Thành viên", "gender": "female"}, {"name": "Trần Văn B", "position": "Chủ tịch", "gender": "male"}, {"name": "trần văn b", "gender": "m"}, {"name": "Công ty X"}, {"name": "Solo"}])
    text = "Ban kiểm soát Ông Lê Văn An Trưởng ban Bà Đỗ Thị Bình Thành viên Ông Phạm Minh Châu Thành viên Thuyết minh"
    rows = spark.createDataFrame([("GOV_DIRECTORY_FS", details, text), ("GOV_SUPERVISORY_FS", details, text), ("GOV_SUPERVISORY_FS", None, "Uỷ ban")], "item_code string, d string, t string")
    got = [[tuple(m) for m in r.roster] for r in S.statement_rosters(rows, F.col("d"), F.col("t")).collect()]
    assert got[0] == [("Nguyễn Thị A", "Bà"), ("Trần Văn B", "Ông")]
    assert got[1] == [("Lê Văn An", "Ông"), ("Đỗ Thị Bình", "Bà"), ("Phạm Minh Châu", "Ông")]
    assert got[2] == []


@pytest.mark.parametrize(
    "token, garbled",
    [("Vi3t", True), ("ph6ng", True), ("công", False), ("a@b.vn", False), ("www.abc.com", False), ("file.pdf", False), ("a/b", False), ("TP.Hanoi", False), ("x_1y", False), ("**b1c**", False), ("c#ng", True), ("AB1C", False), ("1a", False), ("20%", False), ("ch[a]c", True)],
)
def test_garbled(spark, token, garbled):
    assert one(spark, Q.is_garbled(F.col("t")), t=token) == garbled


def test_quality_status(spark):
    good = "Báo cáo thường niên của công ty năm nay trình bày kết quả kinh doanh\n" * 20
    spaced = "V i e t N a m c o n g t y b a o c a o xong\n"
    rows = [("good", good), ("empty", ""), (None, None), ("spaced", spaced * 4 + good), ("garbled", ("ph6ng " * 6 + good) * 3), ("short", "a b c d")]
    got = {r.k: r for r in Q.quality(spark.createDataFrame(rows, "k string, content string")).collect()}
    assert [got[k].quality_status for k in ("good", "empty", None, "spaced", "garbled", "short")] == ["pass", "pass", "pass", "fail", "fail", "fail"]
    assert got["spaced"].broken_spacing_count == 4 and got["spaced"].affected_region_count == 1 and got["spaced"].affected_line_count == 4
    assert got["garbled"].garbled_count == 18 and "garbled_vietnamese_tokens" in got["garbled"].quality_reason


def test_chunk_windows(spark):
    for n in range(0, 38):
        words = [f"w{i}" for i in range(n)]
        want, start = [], 0
        while start < n:
            want.append(" ".join(words[start : start + 8]))
            if start + 8 >= n:
                break
            start += 6
        rows = spark.createDataFrame([(1, " ".join(words))], "id int, content string")
        got = sorted((r.chunk_index, r.chunk_text) for r in Q.chunks(rows, 8, 2).collect())
        assert [t for _, t in got] == want and [i for i, _ in got] == list(range(len(want)))
        if n > 20 and n % 5:
            continue


def test_texts(spark):
    assert one(spark, X.plain_vietnamese(F.col("t")), t="  Đại hội CỔ ĐÔNG é ") == "dai hoi co dong e"
    assert one(spark, X.history_year(F.col("t")), t="a12019 b 1987x 2004") == 1987
    assert one(spark, X.title_year(F.col("t")), t="x") is None
    assert one(spark, X.failed_step(F.col("t")), t="Recognizing Layout ... recognizing text") == "text"
    assert one(spark, X.big4(F.col("t")), t="Công ty TNHH Ernst & Young Việt Nam") == "EY"
    assert one(spark, X.firm_age(F.col("y"), F.lit(2000)), y=2010) == 0
    empty = F.array().cast("array<double>")
    assert one(spark, guarded_similarity(empty, empty), y=1) == -1.0 and one(spark, guarded_similarity(F.array(F.lit(1.0)), F.array(F.lit(0.0))), y=1) == -1.0


def test_budget_and_evaluation(spark):
    rows = spark.createDataFrame([("a", i, "t", n) for i, n in enumerate([50, 60, 10])] + [("b", 0, "t", 500)], "k string, chunk_index int, chunk_text string, token_count int")
    got = sorted((r.k, r.chunk_index, r.used_tokens) for r in Q.within_budget(rows, ["k"], budget=100).collect())
    assert got == [("a", 0, 50), ("b", 0, 100)]
    assert {r.k: r.prompt for r in Q.prompt_text(Q.within_budget(rows, ["k"], budget=1000), ["k"]).collect()}["b"] == "[chunk_index=-1]\nt"
    cases = spark.createDataFrame([(1, ["X "], ["z"]), (2, None, None), (3, ["q"], [])], "case_id int, required_terms array<string>, forbidden_terms array<string>")
    found = spark.createDataFrame([(1, "a  x"), (1, "z"), (2, "any")], "case_id int, chunk_text string")
    got = {r.case_id: tuple(r)[1:] for r in R.retrieval_evaluation(cases, found).collect()}
    assert got == {1: (0.5, 0.5, True), 2: (1.0, 0.0, True), 3: (0.0, 0.0, False)}


def test_state(spark):
    base = spark.createDataFrame([("A", 1, "failed"), ("B", 2, "completed")], "ticker string, year int, status string")
    new = spark.createDataFrame([("A", 1, "completed"), ("A", 1, "completed"), ("C", 3, "pending")], "ticker string, year int, status string")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(U.upsert(base, new, ["ticker", "year"])) == [("A", 1, "completed"), ("B", 2, "completed"), ("C", 3, "pending")]
    several = spark.createDataFrame([("A", 1, "x"), ("A", 1, "y"), (None, 1, "n"), (None, 1, "m")], "ticker string, year int, status string")
    for parts in (1, 2, 4):
        out = {(r.ticker, r.year): r.status for r in U.upsert(base.unionByName(several.where("status = 'n'")), several.withColumn("at", F.monotonically_increasing_id()).repartition(parts), ["ticker", "year"], "at").drop("at").collect()}
        assert out["A", 1] == "y" and out[None, 1] == "m" and len(out) == 3
    scoped = spark.createDataFrame([("A", 1, "GOV_X"), ("A", 1, "GOV_X_FS"), ("B", 1, "GOV_X"), ("A", 1, None)], "ticker string, year int, item_code string")
    assert sorted(map(str, map(tuple, U.scoped_delete(scoped, "A", 1, ["GOV_X"]).collect()))) == sorted(map(str, [("A", 1, "GOV_X_FS"), ("B", 1, "GOV_X"), ("A", 1, None)]))
    assert rows(U.insert_missing(base, new, ["ticker", "year"])) == [("A", 1, "failed"), ("B", 2, "completed"), ("C", 3, "pending")]
    assert rows(U.reset_failed(base))[0] == ("A", 1, "pending")
    assert rows(U.full_refresh(base, base.limit(0))) == rows(base)
    jobs = base.withColumn("model", F.lit("m"))
    batches = spark.createDataFrame([("A", 1, "completed", 3)], "ticker string, year int, batch_status string, n_results int")
    running = jobs.withColumn("status", F.lit("running"))
    assert {r.ticker: r.status for r in U.reconcile(running, batches, 3).collect()} == {"A": "completed", "B": "running"}
    assert {r.ticker: r.status for r in U.reconcile(running, batches, 4).collect()} == {"A": "pending", "B": "running"}
    gone, counts = U.delete_where({"t": base}, ["A"])
    assert gone["t"].count() == 1 and tuple(counts.first()) == ("t", 1)
    documents = spark.createDataFrame([(1, "A", 7, "old"), (2, "B", 8, "x")], "id int, ticker string, file_info_id int, title string")
    update = spark.createDataFrame([(99, "A", 7, "new")], "id int, ticker string, file_info_id int, title string")
    assert rows(U.with_second_key(documents, update, ["id"], ["ticker", "file_info_id"])) == [(1, "A", 7, "new"), (2, "B", 8, "x")]


def test_files(spark, tmp_path):
    for where, name, text in (("one/aaa/2020", "report.md", "first"), ("one/bbb", "x2019.md", "b"), ("two/AAA", "r 2020 é.md", "second"), ("two/ccc", "none.md", "-")):
        (tmp_path / where).mkdir(parents=True, exist_ok=True)
        (tmp_path / where / name).write_text(text)
    got = files.markdown(spark, [str(tmp_path / "one"), str(tmp_path / "two")]).collect()
    assert sorted((r.ticker, r.year, r.content) for r in got) == [("AAA", 2020, "first"), ("BBB", 2019, "b")]
    (tmp_path / "pdf/aaa").mkdir(parents=True)
    for n in ("Báo cáo thường niên năm 2021.pdf", "other.pdf"):
        (tmp_path / "pdf/aaa" / n).write_bytes(b"x")
    valid, odd = files.pdf_inputs(spark, str(tmp_path / "pdf"))
    assert [(r.ticker, r.year) for r in valid.collect()] == [("AAA", 2021)] and odd.count() == 1
    (tmp_path / "t.csv").write_text("ticker,missing_years,duplicate_years,suspiciously_small_years\naaa,2019|2020,2020,2021|2020\nbbb,,,\n,2000,,\n")
    targets = files.rerun_targets(spark, str(tmp_path / "t.csv"))
    assert sorted(tuple(r) for r in targets.collect()) == [("AAA", 2019, "missing", False), ("AAA", 2020, "duplicate+suspicious_small", True), ("AAA", 2021, "suspicious_small", True)]
    (tmp_path / "done.csv").write_text("ticker,year,status\nAAA,2019,ok\nAAA,2021,failed\n")
    assert files.open_targets(targets, files.completed_targets(spark, str(tmp_path / "done*.csv"))).count() == 2
    store = files.Store(spark, str(tmp_path / "store"))
    assert store.read("t", "a int").count() == 0
    store.write("t", spark.range(3))
    store.write("t", store.read("t").where("id > 0"))
    assert store.read("t").count() == 2
    files.write_console_csv(spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().a == "1"
    lines = files.batch_requests(spark.createDataFrame([("c1", "s", "p")], "custom_id string, system string, prompt string"), "m")
    assert json.loads(lines.first().value)["body"]["messages"][1] == {"role": "user", "content": "p"}
    answers = spark.createDataFrame([('{"custom_id":"c1","response":{"status_code":200,"body":{"choices":[{"message":{"content":"hi"}}]}}}',), ('{"custom_id":"c2","response":{"status_code":500}}',)], "value string")
    good, bad = files.batch_results(answers)
    assert tuple(good.first()) == ("c1", "hi") and bad.first().custom_id == "c2"
    assert files.snapshot(spark.range(5).limit(0), str(tmp_path / "snap"), "snap_view").count() == 0


def test_milestones_and_pages(spark):
    page = """<ul><li>menu</li></ul><script>var t_categories = ["2001", "Year 2005"];</script><div><h3>Mốc  lịch <i>sử</i></h3><ul><li>12/03/1999: founded</li><li>no year</li></ul>
      <table><tr><th>5-6-2002</th><td> </td><td>listed<br>twice</td></tr></table><p>In 2010 the firm grew.</p><p>no year here</p><h2>Other</h2><p>In 2011 not told</p></div>"""
    body = '<div class="a company-history__container"><div><b class="company-history__header-title">MỐC LỊCH SỬ</b></div><div class="company-history__body"><p>born</p><p>In 1987 Born</p></div></div>'
    plain = "<p>It was 1990 then<p>short 1<style>1991 is styled</style><div>Since\n2004, and more\n2005</div>"
    rows = spark.createDataFrame([("AAA", page), ("BBB", None), ("CCC", body), ("DDD", plain), ("EEE", "")], "ticker string, html string")
    got = sorted(tuple(r) for r in milestones.milestone_events(rows, "ticker", "html").collect())
    # a heading without the section's class is the first element that holds its words, here the outer div, so the page's lists count
    told = ["2001", "Year 2005", "menu", "12/03/1999: founded", "no year", "5-6-2002 - listed twice"]
    assert [r[4] for r in got if r[0] == "AAA"] == told and [r[3] for r in got if r[0] == "AAA"][3:6] == ["12/03/1999", None, "5-6-2002"]
    assert [r[1:] for r in got if r[0] == "CCC"] == [(1, None, None, "born"), (2, 1987, None, "In 1987 Born")]
    assert [r[1:] for r in got if r[0] == "DDD"] == [(1, 1990, None, "It was 1990 then"), (2, 2004, None, "2004, and more")]
    assert {r[0] for r in got} == {"AAA", "CCC", "DDD"}
    answers = {1: {"data": [{"a": 1}], "totalPages": 2}, 2: {"data": [{"a": 2}], "totalPages": 2}}
    assert [r["a"] for r in rest.pages(lambda i: answers.get(i, {}))] == [1, 2]
    fetched = rest.fetch_all(rows, "ticker", lambda k, i: {"data": [{"v": i}] if i < 3 else []}, "ticker string, v int")
    assert sorted(tuple(r) for r in fetched.collect()) == [(t, i) for t in ("AAA", "BBB", "CCC", "DDD", "EEE") for i in (1, 2)]
    fields = F.create_map(F.lit("FileInfoID"), F.lit("7"), F.lit("title"), F.lit("T"))
    assert one(spark, files.any_case(fields, "fileinfoid"), y=1) == "7"


def test_console(spark):
    for bad in ("", "drop table x", "select 1; select 2", "insert into x select 1", "with a as (select 1) insert into t select * from a"):
        with pytest.raises(ValueError):
            guard(bad)
    console = Console(spark, "/root/testdata/sf0.001")
    assert console.run("SELECT COUNT(*) AS n FROM companies;").first().n > 0
    assert console.run("SUMMARIZE nation").count() > 0
    assert console.template("Governance Item Coverage").count() == 4


def test_streams(spark, tmp_path):
    from tidemark.streaming import ingest

    (tmp_path / "in/aaa").mkdir(parents=True)
    (tmp_path / "in/aaa/r2020.md").write_text("Báo cáo một hai ba")
    store = files.Store(spark, str(tmp_path / "store"))
    ingest.reports_into(spark, str(tmp_path / "in"), store, str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in/aaa/s2020.md").write_text("another text of the report")
    (tmp_path / "in/aaa/r2021.md").write_text("next year of the report")
    ingest.reports_into(spark, str(tmp_path / "in"), store, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.ticker, r.year, r.content) for r in store.read("annual_reports").collect()) == [("AAA", 2020, "another text of the report"), ("AAA", 2021, "next year of the report")]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    query = ingest.event_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("counts").agg(F.sum("events")).first()[0] == events.count()


def test_schema_and_embedding(spark):
    from tidemark import schema
    from tidemark.operators import embedding as E

    assert len(schema.TABLES) == 33 and all(set(schema.key_of(t)) <= set(schema.schema_of(t).names) for t in schema.TABLES)
    old = spark.createDataFrame([("A", 2020, "x")], "ticker string, year int, source_path string")
    row = schema.evolved(old, "conversion_jobs").first()
    assert row.status == "pending" and row.force_ocr is False and row.source_path == "x"

    def small(texts):
        if sum(len(t.split()) for t in texts) > 4:
            raise E.TooLarge
        return E.hashed(texts, 4)

    assert len(E.embed_all(["a b c", "d e f", "g h i j k l m"], small, 8)) == 3
    reports = spark.createDataFrame([("A", 1, "one two three"), ("B", 1, "four")], "ticker string, year int, content string")
    done = reports.where("ticker = 'B'")
    assert [(r.ticker, len(r.embedding)) for r in E.embed_reports(reports, done).collect()] == [("A", 64)]
    asked = spark.createDataFrame([("Q", "a b", ["c"]), ("R", "a", None)], "item string, criterion string, hypotheses array<string>")
    assert {r.item: len(r.query_vector) for r in E.query_vectors(asked).collect()} == {"Q": 64, "R": 64}


def test_refined_rosters(spark):
    from tidemark.operators.rosters import refined

    people = {
        "GOV_DIRECTORY": [{"name": "A", "position": "Chủ tịch HĐQT", "is_independent": True, "gender": "male"}, {"name": "B", "role": "Thành viên HĐQT độc lập", "gender": " Female"}],
        "GOV_EXECUTIVE": [{"name": "C", "position": "Tổng Giám đốc", "notes": "thành viên HĐQT"}, {"name": "D", "position": "Trưởng BKS"}, {"name": "", "position": "CEO"}, {"name": "E", "position": "Kế toán trưởng"}],
        "GOV_SUPERVISORY": [{"name": "F", "position": "Trưởng ban"}, {"name": "G", "position": "Kế toán trưởng"}],
        "GOV_AUDIT": [{"name": "H", "role": "Signing auditor"}, {"name": "I", "role": "BKS"}],
    }
    rows = [(c, json.dumps(p)) for c, p in people.items()] + [("GOV_DIRECTORY", None), ("GOV_DIRECTORY", "null")]
    got = refined(spark.createDataFrame(rows, "item_code string, details_json string")).collect()
    d, e, s, a = got[:4]
    assert (d.total_members, d.independent_count, d.chair_name, d.women_count, d.men_count) == (2, 1, "A", 1, 1)
    assert (e.total_members, e.ceo_name, e.chief_accountant_name, e.board_member_count) == (2, "C", "E", 1)
    assert (s.total_members, s.removed_members) == (1, 1) and a.signing_auditor_names == ["H"]
    assert [r.total_members for r in got[4:]] == [0, 0]


def test_page_trees_leave_in_small_batches(spark):
    """A worker holds the trees of few pages at once, however many a batch brings."""
    page = "<div><p>1999</p></div>"
    rows = spark.range(200).selectExpr("id", f"'{page}' AS html").coalesce(1)
    plan = milestones.trees(rows, "id", "html")
    assert plan.count() == 200 and "MapInArrow" in plan._jdf.queryExecution().optimizedPlan().toString()
    assert [n.tag for n in plan.first().nodes] == ["div", "p"] and milestones.SLICE <= 64
