"""Rosters of an answer made consistent with their item: who belongs, who is independent, what they count.

These rules stand beside the batch path and aren't applied in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any

PERSON = "struct<name string, position string, role string, notes string, organization string, gender string, is_independent string>"
#: Fixed terms of roles.
INDEPENDENT = ["thành viên hđqt độc lập", "thanh vien hdqt doc lap", "thành viên hội đồng quản trị độc lập", "thanh vien hoi dong quan tri doc lap", "tv hdqt độc lập", "tv hdqt doc lap", "independent member"]
CHAIR = ["chủ tịch", "chu tich"]
EXECUTIVE = ["ceo", "tổng giám đốc", "tong giam doc", "phó tổng giám đốc", "pho tong giam doc", "kế toán trưởng", "ke toan truong"]
BOARD = ["hđqt", "hdqt", "hội đồng quản trị", "hoi dong quan tri", "thành viên hđqt", "thanh vien hdqt"]
CHIEF, ACCOUNTANT = ["ceo", "tổng giám đốc", "tong giam doc"], ["kế toán trưởng", "ke toan truong"]
NOT_SUPERVISORY = ["kế toán trưởng", "ke toan truong", "tổng giám đốc", "tong giam doc", "hđqt", "hdqt", "ban điều hành", "ban dieu hanh"]
NOT_AUDITOR = ["ban kiểm soát", "ban kiem soat", "bks", "thành viên bks", "thanh vien bks", "ủy ban kiểm toán", "uy ban kiem toan", "kiểm toán nội bộ", "kiem toan noi bo", "hđqt", "hdqt", "ban điều hành", "ban dieu hanh"]


def _said(m: Column, *fields: str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(m[f], F.lit("")) for f in fields]))


def _yes(text: Column) -> Column:
    return F.coalesce(~F.lower(text).isin("", "false", "0", "null"), F.lit(False))


def _keeps(code: Column, m: Column) -> Column:
    """Whether a member belongs to an item's roster."""
    role = _said(m, "position", "role", "notes")
    executive = contains_any(role, EXECUTIVE) & (F.trim(F.coalesce(m["name"], F.lit(""))) != "")
    return (
        F.when(code == "GOV_EXECUTIVE", executive)
        .when(code == "GOV_SUPERVISORY", ~contains_any(role, NOT_SUPERVISORY))
        .when(code == "GOV_AUDIT", ~contains_any(_said(m, "name", "role", "organization", "notes"), NOT_AUDITOR))
        .otherwise(True)
    )


def _first_name(members: Column, terms: list[str], *fields: str) -> Column:
    return F.get(F.filter(members, lambda m: contains_any(_said(m, *fields), terms)), F.lit(0))["name"]


def refined(results: DataFrame, details: str = "details_json", code: str = "item_code") -> DataFrame:
    """``results`` with their members (kept ones only) and what follows from them."""
    item = F.col(code)
    people = F.coalesce(F.from_json(F.when(F.trim(details) != "null", F.col(details)), f"array<{PERSON}>"), F.array().cast(f"array<{PERSON}>"))
    out = results.withColumn("x_all", people)
    out = out.withColumn("x_kept", F.filter("x_all", lambda m: _keeps(item, m)))
    marked = F.transform(
        "x_kept",
        lambda m: F.struct(
            m["name"].alias("name"), m["position"].alias("position"), m["role"].alias("role"), m["gender"].alias("gender"),
            F.when(item == "GOV_DIRECTORY", contains_any(_said(m, "position", "role", "notes"), INDEPENDENT)).otherwise(_yes(m["is_independent"])).alias("is_independent"),
            (item == "GOV_EXECUTIVE").alias("is_executive"),
            ((item == "GOV_EXECUTIVE") & contains_any(_said(m, "position", "role", "notes"), BOARD)).alias("is_board_member"),
        ),
    )
    out = out.withColumn("members", marked)
    gender = lambda g: F.size(F.filter("members", lambda m: F.lower(F.trim(F.coalesce(m["gender"], F.lit("")))) == g))
    only = lambda c, value: F.when(item == c, value)
    signing = F.filter("members", lambda m: F.lower(F.coalesce(m["role"], F.lit(""))).contains("signing") & (F.trim(F.coalesce(m["name"], F.lit(""))) != ""))
    return out.withColumns(
        {
            "total_members": F.size("members"),
            "removed_members": F.size("x_all") - F.size("x_kept"),
            "women_count": gender("female"),
            "men_count": gender("male"),
            "independent_count": F.size(F.filter("members", lambda m: m["is_independent"])),
            "board_member_count": F.size(F.filter("members", lambda m: m["is_board_member"])),
            "chair_name": only("GOV_DIRECTORY", _first_name(F.col("members"), CHAIR, "position")),
            "ceo_name": only("GOV_EXECUTIVE", _first_name(F.col("members"), CHIEF, "position", "role")),
            "chief_accountant_name": only("GOV_EXECUTIVE", _first_name(F.col("members"), ACCOUNTANT, "position", "role")),
            "signing_auditor_names": only("GOV_AUDIT", F.transform(signing, lambda m: F.trim(m["name"]))),
        }
    ).drop("x_all", "x_kept")
