"""Rosters in texts and the chain over stored answers, by cases."""

import json

from pyspark.sql import functions as F

from tidemark.operators import answers as A

BOARD = "Ban Kiểm soát<br>Bà Nguyễn Thị An Trưởng ban  Ông Trần Văn Bình, Thành viên Ông Trần Văn Bình Thành viên Bà Lê Thị Cúc Thành  viên Kiểm toán viên Ông Phạm Văn Dũng Thành viên"
SEATS = "Ủy ban Kiểm toán Ông Lê Văn Cường Chủ tịch bà Phạm Thị Dung Thành viên Ông Công ty Kiểm Toán Thành viên Bà Phạm Thị Dung Thành viên Thuyết minh Ông Hồ Văn Em Thành viên"
NEXTS = "Ủy ban kiểm toán: Ông Đỗ Văn Giang Bà Hoàng Thị Hà Ông Vũ Văn Ích"


def rosters(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("listed", F.lit("clash"))
    out = A.text_rosters(df, F.col("text")).orderBy("i").collect()
    return [(r.listed_by, [(m.name, m.position, m.gender) for m in r.listed]) for r in out]


def test_rosters_of_board_and_committee(spark):
    got = rosters(spark, [BOARD, SEATS, NEXTS, NEXTS + " Thuyết minh", "Ủy ban kiểm toán", "", None, BOARD + SEATS, "Ủy ban kiểm toán Ông A1 B2 Chủ tịch Ông Một Thành viên"])
    assert got[0] == ("supervisory", [("Nguyễn Thị An", "Trưởng ban", "female"), ("Trần Văn Bình", "Thành viên", "male"), ("Lê Thị Cúc", "Thành viên", "female")])
    assert got[1] == ("committee", [("Lê Văn Cường", "Ủy ban kiểm toán - Chủ tịch", "male"), ("Phạm Thị Dung", "Ủy ban kiểm toán - Thành viên", "female")])
    # without roles a name reaches to the next honorific that lets the match end, at most six words
    assert got[2][0] == "committee_next" and got[2][1][0] == ("Đỗ Văn Giang", "Ủy ban kiểm toán - Thành viên", "male")
    assert [m[0] for m in got[2][1]][-1] == "Vũ Văn Ích" and len(got[2][1]) == 3
    assert [m[0] for m in got[3][1]] == ["Đỗ Văn Giang", "Hoàng Thị Hà"]  # the last one has neither a next nor the end
    assert got[4] == got[5] == got[6] == (None, []) and got[7][0] == "supervisory" and got[8] == (None, [])


def test_names_of_committee_members(spark):
    raw = [" Lê  Văn A. ", "Lê Văn A Thành viên", "Một", "a b c d e f g", "Lê Văn 4", "Hội đồng Quản Trị", None, ""]
    df = spark.createDataFrame([(r,) for r in raw], "n string")
    assert [r[0] for r in df.select(A.committee_name(F.col("n"))).collect()] == ["Lê Văn A", "Lê Văn A", "", "a b c d e f", "", "", None, ""]


FS, AR = "financial_statement_document_embeddings", "document_embeddings"


def test_chain(spark):
    one = '[{"name": "Ông Trần Văn Bảo", "gender": "male", "shares": 3}]'
    rows = [
        ("GOV_SUPERVISORY", AR, "no json", BOARD),
        ("GOV_SUPERVISORY", AR, '{"details": [], "value": {"total_members": 9}, "reason": "none seen"}', SEATS),
        ("GOV_SUPERVISORY", AR, f'{{"details": {one}, "value": null, "reason": "r"}}', BOARD),
        ("GOV_SUPERVISORY", FS, f'{{"details": {one}, "value": {{"a": 1}}, "reason": ""}}', BOARD),
        ("GOV_SUPERVISORY", FS, '{"details": "x"}', ""),
        ("GOV_DIRECTORY", FS, f'{{"details": {one}, "value": {{"a": 1}}}}', BOARD),
        ("GOV_DIRECTORY", AR, '{"details": [], "value": {}}', BOARD),
        ("GOV_SHAREHOLDERS", FS, '{"value": {"foreign_ownership_pct": 3.5}, "details": []}', BOARD),
        ("GOV_DIRECTORY", AR, None, BOARD),
        ("GOV_DIRECTORY", AR, "[1]", BOARD),
        ("GOV_SHAREHOLDERS", AR, '{"value": null}', None),
    ]
    df = spark.createDataFrame([("AAA", 2000 + i, *r) for i, r in enumerate(rows)], "ticker string, year int, item_code string, source_table string, raw string, text string")
    got = [r.asDict() for r in A.processed(df).orderBy("year").collect()]
    brief = [(r["item_code"], r["found"], r["provenance"]) for r in got]
    assert brief == [
        ("GOV_SUPERVISORY", True, ["unparsed", "fallback:supervisory"]), ("GOV_SUPERVISORY", True, ["fallback:committee"]), ("GOV_SUPERVISORY", True, []),
        ("GOV_SUPERVISORY_FS", True, ["statement", "longer"]), ("GOV_SUPERVISORY_FS", False, ["statement"]), ("GOV_DIRECTORY_FS", True, ["statement"]),
        ("GOV_DIRECTORY", False, []), ("GOV_SHAREHOLDERS", True, []), ("GOV_DIRECTORY", False, ["unparsed"]), ("GOV_DIRECTORY", False, ["unparsed"]), ("GOV_SHAREHOLDERS", False, []),
    ]
    assert json.loads(got[0]["value_json"]) == {"total_members": 3, "women_count": 2, "men_count": 1, "independent_count": 0}
    assert got[0]["reason"] == f"Failed to parse LLM response: no json ({A.APPLIED})" and got[1]["reason"] == f"none seen ({A.APPLIED})"
    member = json.loads(got[1]["details_json"])[0]
    assert member["name"] == "Lê Văn Cường" and member["notes"] == A.COMMITTEE_NOTE and member["shares_owned"] is None and list(member)[:3] == ["name", "position", "gender"]
    assert json.loads(got[2]["details_json"])[0]["shares"] == 3 and got[2]["value_json"] == "null"
    assert json.loads(got[3]["details_json"]) == [{"name": "Nguyễn Thị An", "gender": "Bà"}, {"name": "Trần Văn Bình", "gender": "Ông"}, {"name": "Lê Thị Cúc", "gender": "Bà"}] and got[3]["value_json"] == "{}" and got[3]["reason"] == A.USED
    assert json.loads(got[5]["details_json"]) == [{"name": "Trần Văn Bảo", "gender": "Ông"}]
    assert json.loads(got[7]["value_json"]) == {"foreign_ownership_pct": 3.5}
