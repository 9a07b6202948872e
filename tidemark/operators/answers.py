"""Stored governance answers after a batch: a chain of rules, each with what it found, run once over all of them.

1. An answer that is no JSON object has no value and no members, and says so.
2. A supervisory answer without members takes those that the statement's text lists: of the supervisory board, else of
   the audit committee, whose members count by a role after the name, else by the next honorific after it.
3. Answers under a statement's code keep names and labels of persons alone; a longer list in the text replaces a
   supervisory one.
4. Found is what has members, or a value that isn't empty.

``provenance`` names the rules that changed an answer, in order.  All steps are columns, so an answer is parsed where
it is read and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import break_tags, squash, strip_accents
from .scoring import EDGE, NAME, ROSTERS, UPPER, gender_label, person_name, stored_code

#: Fixed patterns: a name, what follows a committee member, words that no name has, and notes of the rules.
WORD = f"[{UPPER}][{NAME}]+"
PERSON = f"(Ông|Bà)\\s+({WORD}(?:\\s+{WORD}){{1,5}})"
NEXT_OR_END = r"(?=\s+(?:Ông|Bà)\s+|$)"
TRAILING_ROLE = r"(?iU)\b(Chủ\s+tịch|Thành\s+viên)\b$"
NOT_A_NAME = ["hội đồng", "ban kiểm soát", "ban tổng", "tổng giám đốc", "công ty", "báo cáo", "kiểm toán"]
COMMITTEE, MEMBER = "Ủy ban kiểm toán - ", "Thành viên"
ROSTER_NOTE = "Parsed from compact BKS roster line in financial statement."
COMMITTEE_NOTE = "Parsed from Audit Committee roster in financial statement as supervisory proxy when BKS roster is absent."
APPLIED = "Applied supervisory fallback parsing from financial-statement roster text."
USED = "Used fallback roster parsing from financial statement text."

_PEOPLE = "array<struct<name string, position string, gender string>>"
_MISSING = ["is_independent", "date_of_birth", "appointment_date", "term_end", "education", "shares_owned"]


def _let(value: Column, use) -> Column:
    """Use a value more than once and compute it once."""
    return F.transform(F.array(value), use)[0]


def _section(df: DataFrame, kind: str, name: str) -> DataFrame:
    """What stands between a roster's anchor and the next heading; ``a_flat`` and ``a_plain`` are the text and its plain form."""
    anchor, stops, most, _ = ROSTERS[kind]
    out = df.withColumn("a_start", F.locate(anchor, F.col("a_plain")))
    places = [F.position(F.lit(s), F.col("a_plain"), F.col("a_start") + 1) for s in stops]
    end = F.least(*[F.when(p > 0, p) for p in places], F.length("a_flat") + 1)
    section = F.substring(F.substr(F.col("a_flat"), F.col("a_start"), end - F.col("a_start")), 1, most)
    return out.withColumn(name, F.when(F.col("a_start") > 0, section).otherwise(""))


def _matches(section: str, pattern: str, position) -> Column:
    """(name, position, gender) of each match; ``position`` takes the third group, or is the one of all."""
    groups = {1: "h", 2: "n"} | ({3: "p"} if callable(position) else {})
    found = F.arrays_zip(*[F.regexp_extract_all(section, F.lit(pattern), i).alias(n) for i, n in groups.items()])
    gender = lambda r: F.when(F.lower(r["h"]) == "bà", "female").otherwise("male")
    return F.transform(found, lambda r: F.struct(r["n"].alias("name"), (position(r["p"]) if callable(position) else F.lit(position)).alias("position"), gender(r).alias("gender")))


def committee_name(raw: Column) -> Column:
    """A committee member's name: two to six words, no role at its end, no digits or headings; else empty."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(squash(raw), EDGE, ""), TRAILING_ROLE, ""), EDGE, "")
    bad = "|".join(NOT_A_NAME)
    words = F.filter(F.split(bare, " "), lambda w: w != "")
    joined = lambda w: _let(F.array_join(F.slice(w, 1, 6), " "), lambda n: F.when((F.size(w) < 2) | n.rlike(r"(?U)\d") | F.lower(n).rlike(bad), "").otherwise(n))
    return _let(words, joined)


def _once(df: DataFrame, people: Column, name: str) -> DataFrame:
    """The first of each name with one, whatever its case."""
    out = df.withColumn("a_named", F.filter(people, lambda m: m["name"] != ""))
    out = out.withColumn("a_lower", F.transform("a_named", lambda m: F.lower(m["name"])))
    return out.withColumn(name, F.filter("a_named", lambda m, i: F.array_position("a_lower", F.lower(m["name"])) == i + 1)).drop("a_named", "a_lower")


def text_rosters(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with ``listed`` (members that its text lists) and ``listed_by``: 'supervisory', 'committee', 'committee_next' or null.

    Texts must be composed (NFC); null and empty ones list none.  The sections end at the next heading, after 2000 and
    2500 characters at most.
    """
    kept = df.columns
    out = df.withColumn("a_flat", squash(break_tags(F.coalesce(text, F.lit("")))))
    out = out.withColumn("a_plain", F.lower(strip_accents(F.col("a_flat"))))
    out = _section(_section(out, "supervisory", "a_board"), "audit_committee", "a_seats")
    board = F.transform(_matches("a_board", f"(?iU){PERSON}\\s+({ROSTERS['supervisory'][3]})", lambda p: p), lambda m: m.withField("name", F.regexp_replace(m["name"], EDGE, "")))
    seats = _matches("a_seats", f"(?iU){PERSON}\\s+(Chủ tịch|Thành viên)", lambda p: F.concat(F.lit(COMMITTEE), p))
    nexts = _matches("a_seats", f"(?iU){PERSON}{NEXT_OR_END}", COMMITTEE + MEMBER)
    clean = lambda people: F.transform(people, lambda m: m.withField("name", committee_name(m["name"])))
    out = _once(_once(_once(out, board, "a_board"), clean(seats), "a_with_role"), clean(nexts), "a_with_next")
    rules = [("supervisory", "a_board"), ("committee", "a_with_role"), ("committee_next", "a_with_next")]
    by = F.coalesce(*[F.when(F.size(c) > 0, F.lit(n)) for n, c in rules])
    out = out.withColumn("listed_by", by)
    listed = F.coalesce(*[F.when(F.col("listed_by") == n, F.col(c)) for n, c in rules], F.array().cast(_PEOPLE))
    return out.withColumn("listed", listed).select(*[c for c in kept if c not in ("listed", "listed_by")], "listed", "listed_by")


def _is_true(json: Column) -> Column:
    """Whether a JSON value is neither null, false, zero nor empty."""
    text = F.trim(json)
    return text.isNotNull() & ~text.isin("null", "false", "[]", "{}", '""', "0", "-0", "0.0", "-0.0") & ~text.rlike(r"^[\[{]\s*[\]}]$") & (text != "")


def _json(members: Column, note: Column) -> Column:
    """Members in the stored layout."""
    rest = [F.lit(None).cast("string").alias(n) for n in _MISSING]
    return F.to_json(F.transform(members, lambda m: F.struct(m["name"].alias("name"), m["position"].alias("position"), m["gender"].alias("gender"), *rest, note.alias("notes"))), {"ignoreNullFields": "false"})


def processed(answers: DataFrame) -> DataFrame:
    """(ticker, year, item_code, found, value_json, details_json, reason, provenance) of answers
    (ticker, year, item_code, source_table, raw, text); ``item_code`` comes out as the code it is stored under.

    Null answers are no JSON; JSON is compact; members of a statement's answer are those with a person's name.
    """
    rows = answers.select("ticker", "year", F.col("item_code").alias("code"), stored_code(F.col("item_code"), F.col("source_table")).alias("item_code"), F.coalesce("raw", F.lit("")).alias("raw"), F.col("text"))
    rows = rows.withColumn("sound", F.coalesce(F.schema_of_variant(F.try_parse_json("raw")).startswith("OBJECT"), F.lit(False)))
    field = lambda name: F.when(F.col("sound"), F.to_json(F.try_variant_get(F.try_parse_json("raw"), f"$.{name}", "variant")))
    rows = rows.withColumns({"value_json": F.coalesce(field("value"), F.lit("null")), "own": F.coalesce(field("details"), F.when(F.get_json_object("raw", "$.details").isNull(), F.lit("[]")))})
    rows = rows.withColumn("own", F.coalesce("own", F.lit("[]")))
    rows = rows.withColumn("reason", F.when(~F.col("sound"), F.concat(F.lit("Failed to parse LLM response: "), F.col("raw"))).otherwise(F.coalesce(F.get_json_object("raw", "$.reason"), F.lit(""))))
    rows = text_rosters(rows, F.col("text")).drop("text")

    # 2: no members in a supervisory answer
    none = ~F.trim("own").startswith("[") | ~_is_true(F.col("own"))
    rows = rows.withColumn("fallback", (F.col("code") == "GOV_SUPERVISORY") & none & F.col("listed_by").isNotNull())
    count = lambda g: F.size(F.filter("listed", lambda m: m["gender"] == g))
    value = F.to_json(F.struct(F.size("listed").alias("total_members"), count("female").alias("women_count"), count("male").alias("men_count"), F.lit(0).alias("independent_count")))
    note = F.when(F.col("listed_by") == "supervisory", ROSTER_NOTE).otherwise(COMMITTEE_NOTE)
    said = lambda text: F.when(F.trim("reason") != "", F.concat(F.trim("reason"), F.lit(f" ({text})"))).otherwise(F.lit(text))
    rows = rows.withColumns(
        {
            "value_json": F.when(F.col("fallback"), value).otherwise(F.col("value_json")),
            "details_json": F.when(F.col("fallback"), _json(F.col("listed"), note)).when((F.col("code") == "GOV_SUPERVISORY") & ~F.trim("own").startswith("[") & ~F.col("sound"), F.lit("[]")).otherwise(F.col("own")),
            "reason": F.when(F.col("fallback"), said(APPLIED)).otherwise(F.col("reason")),
        }
    )

    # 3: answers under a statement's code
    person = lambda m: F.struct(person_name(m["name"]).alias("name"), gender_label(m["gender"]).alias("gender"))
    members = F.coalesce(F.from_json("details_json", "array<struct<name string, gender string>>"), F.array().cast("array<struct<name string, gender string>>"))
    rows = _once(_once(rows, F.transform(members, person), "kept"), F.transform("listed", person), "read")
    statement = F.col("item_code").endswith("_FS")
    rows = rows.withColumn("longer", (F.col("item_code") == "GOV_SUPERVISORY_FS") & (F.size("read") > F.size("kept")))
    rows = rows.withColumns(
        {
            "details_json": F.when(statement, F.to_json(F.when(F.col("longer"), F.col("read")).otherwise(F.col("kept")))).otherwise(F.col("details_json")),
            "value_json": F.when(statement, F.lit("{}")).otherwise(F.col("value_json")),
            "reason": F.when(F.col("longer"), said(USED)).otherwise(F.col("reason")),
        }
    )
    value = F.trim("value_json")
    found = _is_true(F.col("details_json")) | ((value != "null") & ~value.rlike(r"^\{\s*\}$"))
    applied = {"unparsed": ~F.col("sound"), "fallback": F.col("fallback"), "statement": statement, "longer": F.col("longer")}
    named = [F.when(c, F.concat(F.lit("fallback:"), F.col("listed_by")) if n == "fallback" else F.lit(n)) for n, c in applied.items()]
    return rows.select("ticker", "year", "item_code", found.alias("found"), "value_json", "details_json", "reason", F.array_compact(F.array(*named)).alias("provenance"))
