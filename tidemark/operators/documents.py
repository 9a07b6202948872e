"""Report texts: quality scores, overlapping chunks, chunk tags, token budgets.  All JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any, markdown_year, plain_vietnamese, preferred_title, squash, title_quality

#: Fixed character classes, limits and weights of the quality score.
LETTER = "A-Za-zÀ-ỹĐđ"
TOKEN = f"([0-9{LETTER}]+)"
#: Letters that stand alone, one after the other; possessive, as a long run would overflow the matcher's stack.
BROKEN_SPACING = rf"(?U)(\b(?:[{LETTER}]\s+(?=[{LETTER}]\b)){{3,}}+[{LETTER}])"
GARBLED = r"0-9,./%*+#&@\\()\[\]{}|^~="
#: A word with a digit or sign before a letter, as every garbled one has; possessive, so one pass over a text.
MAY_BE_GARBLED = rf"(?U)(?<!\S)[^\s{GARBLED}]*+[{GARBLED}][^\s{LETTER}]*+[{LETTER}]\S*+"
#: A token of one character.
SINGLE = f"(?<![0-9{LETTER}])[0-9{LETTER}](?![0-9{LETTER}])"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
LEAST_SPACED_CHARS, REGION_GAP = 25, 5
SINGLE_CHAR_RATIO, SHORT_TOKENS, GARBLED_RATIO, SPACED_COUNT = 0.18, 2.2, 0.015, 3
WARNING_SCORE, FAIL_SCORE, FAIL_SPACED, FAIL_REGIONS, FAIL_LINE_RATIO = 0.45, 0.6, 8, 2, 0.01

#: Tokens that are no garbled words, each by a pattern; the first group on the raw token, the second on its core.
NOT_GARBLED_RAW = [r"(?i)!\[\]\(|\]\(#page-|_page_\d+_picture_\d+\.|<span|</span>|id=\"page-|^#page-", r"[\\{}$^]", r"\*\*", "[@<>]"]
NOT_GARBLED_CORE = [
    "(?i)https?://",
    r"^[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$",
    r"(?i)\.(?:jpeg|jpg|png|gif|webp|svg|pdf)$",
    rf"^\(?[{LETTER}]{{1,4}}\.[A-ZÀ-ỸĐ][{LETTER}-]+$",
    "_",
    rf"^(?=.*/)/*(?:[()]*[{LETTER}0-9μ.-]+[()]*(?:/+|$))+$",
    r"(?:^|[/.])(?=[^/.]*\p{Lu})[^/.\p{Ll}]*(?:$|[/.])",
]
EDGES = "'\"`*_~“”‘’<>\\[\\]{}().,;:!?"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), 1)


def is_garbled(token: Column) -> Column:
    """A word with a digit or sign between letters that no rule explains."""
    core = F.regexp_replace(token, f"^[{EDGES}]+|[{EDGES}]+$", "")
    excused = reduce(lambda a, b: a | b, [token.rlike(p) for p in NOT_GARBLED_RAW] + [core.rlike(p) for p in NOT_GARBLED_CORE])
    only_slash = ~F.translate(core, "/", "").rlike(f"[{GARBLED}]")
    return (F.length(core) >= 3) & core.rlike(f"[{LETTER}].*[{GARBLED}].*[{LETTER}]") & ~only_slash & ~excused


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def garbled_words(text: Column) -> Column:
    """The garbled words of a text; rules are asked only for words that may be garbled."""
    return F.filter(F.regexp_extract_all(text, F.lit(MAY_BE_GARBLED), 0), is_garbled)


def spaced_matches(text: Column) -> Column:
    """Letters that stand apart, such as a word set with spaces, of some length."""
    return F.filter(F.regexp_extract_all(text, F.lit(BROKEN_SPACING), 1), lambda m: F.length(m) >= LEAST_SPACED_CHARS)


def regions(lines: Column, gap: int = REGION_GAP) -> Column:
    """How many runs of line numbers there are when a run bridges up to ``gap`` lines."""
    return F.size(F.filter(lines, lambda x, i: (i == 0) | (x - F.get(lines, i - 1) > gap)))


def quality(reports: DataFrame, text_column: str = "content") -> DataFrame:
    """``reports`` with the quality columns of their text; a text without tokens passes."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    lines = F.split(text, LINE_BREAK)
    out = reports.withColumns({"q_tokens": tokens(text), "q_lines": lines, "q_single": F.regexp_extract_all(text, F.lit(SINGLE), 0)})
    out = out.withColumns(
        {
            "token_count": F.size("q_tokens"),
            "single_char_count": F.size("q_single"),
            "isolated_diacritic_count": F.regexp_count(F.array_join("q_single", ""), F.lit("[À-ỹ]")),
            "q_chars": F.length(F.array_join("q_tokens", "")),
            "broken_spacing_count": F.size(spaced_matches(text)),
            "q_garbled": F.transform("q_lines", lambda x: F.size(garbled_words(x))),
            "q_nonempty": F.size(F.filter("q_lines", lambda x: x.rlike(r"(?U)\S"))),
        }
    )
    out = out.withColumn("garbled_count", F.aggregate("q_garbled", F.lit(0), lambda a, x: a + x))  # no word goes over a line's end
    n = F.greatest(F.col("token_count"), F.lit(1))
    out = out.withColumns({"single_char_ratio": F.col("single_char_count") / n, "average_token_length": F.col("q_chars") / n, "garbled_ratio": F.col("garbled_count") / n})
    spaced, garbled = F.col("broken_spacing_count") >= SPACED_COUNT, F.col("garbled_ratio") >= GARBLED_RATIO
    hit = lambda x, i: (garbled & (F.get("q_garbled", i) > 0)) | (spaced & (F.size(spaced_matches(x)) > 0))
    numbered = F.transform("q_lines", lambda x, i: F.when(hit(x, i), i + 1))
    out = out.withColumn("affected_lines", F.when(spaced | garbled, F.array_compact(numbered)).otherwise(F.array().cast("array<int>")))
    out = out.withColumns({"affected_line_count": F.size("affected_lines"), "affected_region_count": regions(F.col("affected_lines"))})
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    score = (
        0.45 * clamp(F.col("single_char_ratio") / SINGLE_CHAR_RATIO)
        + 0.35 * clamp(F.col("broken_spacing_count") / 3.0)
        + 0.20 * clamp((SHORT_TOKENS - F.col("average_token_length")) / 1.2)
        + 0.35 * clamp(F.col("garbled_ratio") / GARBLED_RATIO)
    )
    some = F.col("token_count") > 0
    out = out.withColumns({"affected_line_ratio": F.col("affected_line_count") / F.greatest(F.col("q_nonempty"), F.lit(1)), "suspicious_score": F.when(some, score).otherwise(0.0)})
    single, short = F.col("single_char_ratio") >= SINGLE_CHAR_RATIO, F.col("average_token_length") < SHORT_TOKENS
    widespread = (F.col("affected_region_count") >= FAIL_REGIONS) | (F.col("affected_line_ratio") >= FAIL_LINE_RATIO) | (F.col("broken_spacing_count") >= FAIL_SPACED)
    fail = single | short | garbled | (F.col("suspicious_score") >= FAIL_SCORE) | (spaced & widespread)
    status = F.when(~some, "pass").when(fail, "fail").when((F.col("suspicious_score") >= WARNING_SCORE) | spaced, "warning").otherwise("pass")
    names = {"high_single_char_ratio": single, "broken_spacing_patterns": spaced, "short_average_token_length": short, "garbled_vietnamese_tokens": garbled}
    reasons = F.array_join(F.array_compact(F.array(*[F.when(some & c, F.lit(r)) for r, c in names.items()])), ",")
    return out.withColumns({"quality_status": status, "quality_reason": reasons}).drop("q_tokens", "q_lines", "q_single", "q_chars", "q_nonempty", "q_garbled")


#: Fixed markers of financial statements and of letters about them, without accents.
SECTION_MARKERS = ["bang can doi ke toan", "bao cao ket qua hoat dong kinh doanh", "bao cao luu chuyen tien te", "luu chuyen tien te", "thuyet minh bao cao tai chinh"]
DISCLOSURE_MARKERS = ["cong bo thong tin", "nghi quyet", "kinh gui", "uy ban chung khoan", "so giao dich chung khoan"]
LEAST_TOKENS, NOT_A_STATEMENT, LEAST_SCORE = 3000, "non_financial_statement_content", 0.95


def content_checks(scored: DataFrame, text_column: str = "content") -> DataFrame:
    """Scored statements with ``section_count`` and ``disclosure_count``; those that are none fail, with a score of 0.95
    at least, the reason and (where there is that column) evidence.

    A text without a section is none unless it has 3000 tokens and no marker of a letter.
    """
    out = scored.withColumn("c_plain", plain_vietnamese(F.coalesce(F.col(text_column), F.lit(""))))
    held = lambda markers: F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: F.col("c_plain").contains(m))
    out = out.withColumns({"c_sections": held(SECTION_MARKERS), "c_letters": held(DISCLOSURE_MARKERS)})
    out = out.withColumns({"section_count": F.size("c_sections"), "disclosure_count": F.size("c_letters")})
    other = (F.col("section_count") == 0) & ((F.col("token_count") < LEAST_TOKENS) | (F.col("disclosure_count") > 0))
    out = out.withColumn("c_other", other)
    reasons = F.filter(F.split("quality_reason", ","), lambda r: r != "")
    changed = {
        "quality_status": F.lit("fail"),
        "suspicious_score": F.greatest("suspicious_score", F.lit(LEAST_SCORE)),
        "quality_reason": F.array_join(F.array_union(reasons, F.array(F.lit(NOT_A_STATEMENT))), ","),
    }
    if "quality_evidence" in scored.columns:
        counts = F.format_string("content_check=sections=%d disclosures=%d tokens=%d", "section_count", "disclosure_count", "token_count")
        letters = F.when(F.col("disclosure_count") > 0, F.concat(F.lit("disclosure_markers="), F.array_join("c_letters", ",")))
        changed["quality_evidence"] = F.concat_ws(" || ", F.nullif(F.trim("quality_evidence"), F.lit("")), counts, letters)
    return out.withColumns({c: F.when(F.col("c_other"), value).otherwise(F.col(c)) for c, value in changed.items()}).drop("c_plain", "c_sections", "c_letters", "c_other")


def computed(scored: DataFrame) -> DataFrame:
    """The same rows, whose columns a filter after it doesn't compute again: nothing is pushed through the generator."""
    return scored.select(F.inline(F.array(F.struct(*scored.columns))))


def quality_reruns(scored: DataFrame, statuses: list[str], min_garbled: int, limit: int = 0) -> DataFrame:
    """Reports of some statuses in the order of an audit, all of them without a ``limit``; those that didn't fail need a number of garbled words."""
    chosen = computed(scored).where(F.col("quality_status").isin(statuses) & ((F.col("quality_status") == "fail") | (F.col("garbled_count") >= min_garbled)))
    chosen = audit_order(chosen)
    return chosen.limit(limit) if limit > 0 else chosen


def suspicious_first(scored: DataFrame, least: float = 0.45) -> DataFrame:
    """Reports of at least a score, the worst first."""
    return computed(scored).where(F.col("suspicious_score") >= least).orderBy(F.desc("suspicious_score"), F.desc("broken_spacing_count"), F.desc("single_char_ratio"))


def audit_order(scored: DataFrame) -> DataFrame:
    """Failed reports, then warnings, then the rest; in each the most garbled first."""
    rank = F.when(F.col("quality_status") == "fail", 0).when(F.col("quality_status") == "warning", 1).when(F.col("quality_status") == "pass", 2).otherwise(3)
    return scored.orderBy(rank, F.desc("garbled_count"), F.desc("garbled_ratio"), F.desc("suspicious_score"), "ticker", "year")


def needs_ocr(pages: DataFrame, key: str, page: str, text: str, sample: int = 5, least: float = 100) -> DataFrame:
    """(key, pages, sampled_chars, needs_ocr): whether evenly spaced pages, numbered from 0, hold few characters on average.

    Lengths are taken where the texts are, so no text is shuffled.
    """
    size = F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)^\s+|\s+$", ""))
    counts = pages.groupBy(key).agg(F.count("*").alias("n_pages"))
    both = pages.select(key, F.col(page).alias("o_page"), size.alias("o_size")).join(counts, key)
    taken = F.least(F.lit(sample), "n_pages")
    step = F.floor(F.col("n_pages") / taken)
    sampled = (F.col("o_page") % step == 0) & (F.col("o_page") < taken * step)
    out = both.groupBy(key, "n_pages").agg(F.sum(F.when(sampled, F.col("o_size")).otherwise(0)).alias("sampled_chars"))
    return out.withColumn("needs_ocr", F.col("sampled_chars") / taken < least)


def statement_source(files: DataFrame, keys: list[str], ties: list[str] = []) -> DataFrame:
    """(keys, path) of the best file (name, size, path): preferred title, title's points, size, name, then ``ties``."""
    title = F.regexp_replace("name", r"(?<=.)\.[^.]*$", "")
    order = F.struct(preferred_title(title).cast("int"), title_quality(title), F.coalesce("size", F.lit(0)), "name", *ties)
    return files.groupBy(keys).agg(F.max_by("path", order).alias("path"))


def chunks(reports: DataFrame, size: int = 512, overlap: int = 128, text_column: str = "content") -> DataFrame:
    """Windows of ``size`` words that overlap; blank ones take no index and the last one reaches the end."""
    step = size - overlap
    words = _words(F.coalesce(F.col(text_column), F.lit("")))
    out = reports.withColumn("c_words", words)
    n = F.size("c_words")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    starts = F.filter(starts, lambda x: (x == 0) | (x - step + size < n))
    windows = F.transform(starts, lambda x: F.slice("c_words", x + 1, size))
    out = out.select(*[c for c in reports.columns if c != text_column], F.posexplode(windows).alias("chunk_index", "c_window"))
    return out.select(*[c for c in out.columns if c != "c_window"], F.array_join("c_window", " ").alias("chunk_text"), F.size("c_window").alias("token_count"))


#: Fixed values, section tags: the terms that tell them and the role tag that follows.
SECTION_TERMS = {
    "leadership_overview": ["thong tin chung", "thông tin chung", "gioi thieu", "giới thiệu"],
    "board_of_directors": ["hoi dong quan tri", "hội đồng quản trị", "hdqt", "hđqt"],
    "executive_board": ["ban dieu hanh", "ban điều hành", "ban tong giam doc", "ban tổng giám đốc"],
    "supervisory_board": ["ban kiem soat", "ban kiểm soát", "bks"],
    "audit_report": ["bao cao kiem toan", "báo cáo kiểm toán", "kiem toan doc lap", "kiểm toán độc lập", "cong ty kiem toan", "công ty kiểm toán", "don vi kiem toan", "đơn vị kiểm toán"],
    "shareholders": ["co dong", "cổ đông", "ty le so huu", "tỷ lệ sở hữu", "co cau co dong", "cơ cấu cổ đông"],
}
ROLE_OF = {"board_of_directors": "gov_directory", "executive_board": "gov_executive", "supervisory_board": "gov_supervisory", "audit_report": "gov_audit", "shareholders": "gov_shareholders"}
PERSON_TITLE = r"(?U)\b(ong|ông|ba|bà)\b"
MEMBER_ROLE = r"(?U)\b(thanh vien|thành viên|chu tich|chủ tịch|tong giam doc|tổng giám đốc|truong ban|trưởng ban)\b"


def chunk_metadata(text: Column) -> Column:
    """Section and role tags, up to four headings and three signals of a chunk."""
    def tagged(x: Column) -> Column:  # x.t: the text, x.p: its plain form, each computed once
        text, plain = x["t"], x["p"]
        has = F.array(*[F.when(contains_any(plain, terms), F.lit(tag)) for tag, terms in SECTION_TERMS.items()])
        lines = F.transform(F.split(text, LINE_BREAK), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
        headings = F.filter(lines, lambda x: x.startswith("#") | x.rlike(r"(?U)^\d+(?:\.\d+)*\s+"))
        signals = F.struct(plain.rlike(PERSON_TITLE).alias("has_person_title"), plain.rlike(MEMBER_ROLE).alias("has_member_role"), text.contains("|").alias("has_table_like"))
        return F.struct(F.array_compact(has).alias("tags"), F.transform(F.slice(headings, 1, 4), lambda x: F.substring(x, 1, 140)).alias("heading_hints"), signals.alias("signals"))

    roles = F.create_map(*[F.lit(x) for pair in ROLE_OF.items() for x in pair])

    def whole(x: Column) -> Column:
        role_tags = F.filter(F.transform(x["tags"], lambda t: F.try_element_at(roles, t)), lambda r: r.isNotNull())
        return F.struct(F.lit(1).alias("schema_version"), x["tags"].alias("section_tags"), role_tags.alias("role_tags"), x["heading_hints"].alias("heading_hints"), x["signals"].alias("signals"))

    given = F.coalesce(text, F.lit(""))
    bound = F.transform(F.array(given), lambda t: F.struct(t.alias("t"), squash(F.lower(t)).alias("p")))
    return F.transform(F.transform(bound, tagged), whole)[0]


LLM_METADATA = "struct<section_tags array<string>, role_tags array<string>, signals struct<has_person_title boolean, has_member_role boolean, has_table_like boolean>, summary string, confidence double>"


def cleaned_metadata(raw: Column) -> Column:
    """A model's tags in JSON: known ones once each, confidence within 0 and 1, a short summary; bad JSON gives null."""
    m = F.from_json(raw, LLM_METADATA)
    known = lambda c, allowed: F.array_intersect(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))), F.array(*[F.lit(a) for a in allowed]))
    yes = lambda c: F.coalesce(c, F.lit(False))
    signals = F.struct(*[yes(m["signals"][n]).alias(n) for n in ("has_person_title", "has_member_role", "has_table_like")])
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(m["confidence"], F.lit(0.0))))
    value = F.struct(known(m["section_tags"], SECTION_TERMS).alias("section_tags"), known(m["role_tags"], ROLE_OF.values()).alias("role_tags"), signals.alias("signals"), F.substring(F.coalesce(m["summary"], F.lit("")), 1, 200).alias("summary"), confidence.alias("confidence"))
    return F.when(F.try_parse_json(raw).isNotNull() & m.isNotNull(), value)


def merged_metadata(own: Column, model: Column) -> Column:
    """Both tag lists in order, either signal; without a model's tags the own ones."""
    union = lambda n: F.when(model.isNull(), own[n]).otherwise(F.array_union(own[n], model[n])).alias(n)
    either = F.struct(*[(own["signals"][n] | F.coalesce(model["signals"][n], F.lit(False))).alias(n) for n in ("has_person_title", "has_member_role", "has_table_like")])
    source = F.when(model.isNull(), "deterministic").otherwise("hybrid")
    return F.struct(own["schema_version"].alias("schema_version"), union("section_tags"), union("role_tags"), own["heading_hints"].alias("heading_hints"), either.alias("signals"), model["summary"].alias("summary"), model["confidence"].alias("confidence"), source.alias("metadata_source"))


def within_budget(chunk_rows: DataFrame, keys: list[str], order: str = "chunk_index", budget: int = 120_000) -> DataFrame:
    """Each key's chunks in order up to the first that overflows the budget; a first one too large is cut to it."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = chunk_rows.withColumns({"tokens_upto": F.sum("token_count").over(upto), "place": F.row_number().over(Window.partitionBy(*keys).orderBy(order))})
    first = F.col("place") == 1
    out = out.where(first | (F.col("tokens_upto") <= budget))
    return out.withColumn("used_tokens", F.when(first, F.least("token_count", F.lit(budget))).otherwise(F.col("token_count")).cast("int"))


def prompt_text(kept: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks of each key as one text with their index; index 0 reads -1, as stored prompts have it."""
    shown = F.when(F.col("chunk_index") == 0, -1).otherwise(F.col("chunk_index"))
    piece = F.concat(F.lit("[chunk_index="), shown.cast("string"), F.lit("]\n"), F.col("chunk_text"))
    parts = F.array_sort(F.collect_list(F.struct("place", piece.alias("piece"))))
    return kept.groupBy(keys).agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "\n\n").alias("prompt"))


def batches(rows: DataFrame, keys: list[str], order: list, size: int = 120) -> DataFrame:
    """Batch numbers of ``size`` rows within each key."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size))


def report_files(files: DataFrame, dirs: list[str]) -> DataFrame:
    """Reports from (path, content): ticker, year, the first folder wins; see sources.markdown for the scan."""
    rank = F.coalesce(*[F.when(F.col("path").startswith(d), i) for i, d in enumerate(dirs)])
    base = F.coalesce(*[F.when(F.col("path").startswith(d), F.regexp_replace(F.substring(F.col("path"), len(d) + 1, 100_000), "^/+", "")) for d in dirs])
    parts = F.split("rel", "/")
    out = files.withColumns({"dir_rank": rank, "rel": base}).where("rel is not null and lower(rel) like '%.md'")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    parent = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(""))
    year = F.coalesce(markdown_year(stem), markdown_year(parent), markdown_year(F.col("rel")))
    out = out.withColumns({"ticker": F.upper(parts[0]), "year": year}).where("year is not null")
    best = F.struct("dir_rank", "path")
    return out.groupBy("ticker", "year").agg(F.min_by("path", best).alias("source_file"), F.min_by("content", best).alias("content"))
