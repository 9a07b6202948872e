"""Text expressions as JVM-side columns."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accented() -> tuple[str, str]:
    """All precomposed Latin letters and their base letters, from the Unicode tables."""
    pairs = []
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(point)) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(point):
            pairs.append((chr(point), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accented()


def strip_accents(text: Column, with_d: bool = False) -> Column:
    """Without accents; ``with_d`` also reads the letter d with stroke as d."""
    extra = ("đĐ", "dD") if with_d else ("", "")
    bare = F.translate(text, ACCENTED + extra[0], PLAIN + extra[1])
    return F.regexp_replace(bare, "[\\u0300-\\u036f]", "")


def plain_vietnamese(text: Column) -> Column:
    """Trimmed, small, without accents and stroke; null as empty."""
    return strip_accents(F.lower(F.trim(F.coalesce(text, F.lit("")))), with_d=True)


def squash(text: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def break_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)<br\s*/?>", " ")


def contains_any(text: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(t) for t in terms])


def term_hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms occur; a term that is listed twice counts twice."""
    return reduce(lambda a, b: a + b, [text.contains(t).cast("int") for t in terms], F.lit(0))


def title_year(title: Column) -> Column:
    """The first four digits of a title."""
    return F.regexp_extract(title, "([0-9]{4})", 1).try_cast("int")


def markdown_year(path: Column) -> Column:
    """The first year from 2000 on in a file name."""
    return F.regexp_extract(path, r"(20\d{2})", 1).try_cast("int")


def history_year(text: Column) -> Column:
    """The first year from 1900 on that stands alone."""
    return F.regexp_extract(text, r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1).try_cast("int")


#: Fixed words of titles, without accents, and what they count.
TITLE_POINTS = {"bao cao tai chinh": 60, "bctc": 35, "kiem toan": 25, "hop nhat": 15, "thuyet minh": -35}
NOTICE_WORDS = ["dieu chinh", "dinh chinh", "giai trinh", "bo sung", "thong bao", "phu luc", "cong bo thong tin", "cong van"]
INTERIM_WORDS = ["soat xet", "quy", "6 thang", "9 thang", "cong ty me", "rieng"]


def title_quality(title: Column) -> Column:
    text = plain_vietnamese(title)
    points = [F.when(text.contains(w), p).otherwise(0) for w, p in TITLE_POINTS.items()]
    points += [F.when(text.contains(w), -80).otherwise(0) for w in NOTICE_WORDS]
    return reduce(lambda a, b: a + b, points)


def preferred_title(title: Column) -> Column:
    text = plain_vietnamese(title)
    return contains_any(text, ["bao cao tai chinh", "bctc"]) & text.contains("kiem toan") & ~contains_any(text, [*NOTICE_WORDS, "thuyet minh"])


def audited_annual(title: Column, full_name: Column) -> Column:
    text = plain_vietnamese(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(full_name, F.lit(""))))
    yearly = F.concat(F.lit(" "), text, F.lit(" ")).contains(" nam ") | text.rlike("20[0-9]{2}|2100")
    return contains_any(text, ["bao cao tai chinh", "bctc"]) & text.contains("kiem toan") & yearly & ~contains_any(text, INTERIM_WORDS)


def big4(firm: Column) -> Column:
    """The Big 4 label of an audit firm's name, else null."""
    text = plain_vietnamese(firm)
    return (
        F.when(contains_any(text, ["deloitte", "dttl"]), "Deloitte")
        .when((text.contains("ernst") & text.contains("young")) | F.concat(F.lit(" "), text, F.lit(" ")).contains(" ey ") | text.startswith("ey "), "EY")
        .when(contains_any(text, ["pricewaterhousecoopers", "pwc"]), "PwC")
        .when(text.contains("kpmg"), "KPMG")
    )


def ticker_list(text: Column) -> Column:
    """Tickers of a list typed by lines, commas or spaces: capitals, cut at the first point, first ones only."""
    parts = F.transform(F.split(F.upper(text), r"[\s,;]+"), lambda t: F.trim(F.substring_index(t, ".", 1)))
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def year_list(text: Column, low: int = 1900, high: int = 2100) -> Column:
    years = F.transform(F.split(text, r"[\s,;]+"), lambda t: t.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(years, lambda y: y.between(low, high))))


def billions(value: Column) -> Column:
    """An amount in billions with separators: one digit below one billion, else whole; nothing for 0 and null."""
    n = value.cast("double") / 1e9
    return F.when(value.isNull() | (value == 0), "").when(F.abs(n) < 1, F.format_number(n, 1)).otherwise(F.format_number(n, 0))


def ratio_text(value: Column) -> Column:
    """A ratio with digits by its size: none from 1000 on, two from 1 on, else four; nothing for null."""
    n, size = value.cast("double"), F.abs(value)
    return F.when(value.isNull(), "").when(size >= 1000, F.format_number(n, 0)).when(size >= 1, F.format_number(n, 2)).otherwise(F.format_number(n, 4))


def renamed_folder(path: Column, old: str = "markdown_bctc/", new: str = "markdown_financial_statement/") -> Column:
    """Paths that stores of an older layout hold, in the present one."""
    return F.replace(path, F.lit(old), F.lit(new))


def year_dates(low: int, high: int) -> Column:
    """The last days of years as one comma-separated string."""
    return F.array_join(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda y: F.concat(y.cast("string"), F.lit("-12-31"))), ",")


def firm_age(first_year: Column, this_year: Column) -> Column:
    return F.when(first_year.isNotNull(), F.greatest(F.lit(0), this_year - first_year))


def estimated_tokens(text: Column) -> Column:
    """The estimate without a vocabulary: a quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("int")


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, n), " ")


def base_code(code: Column) -> Column:
    return F.substring_index(code, "_", 1)


def code_version(code: Column) -> Column:
    return F.when(code.contains("_alt_two"), "alt_two").when(code.contains("_alt"), "alt").otherwise("standard")


#: Fixed steps of a conversion log, in the order in which a later one wins.
LOG_STEPS = [("Recognizing Layout", "layout"), ("Running OCR Error Detection", "ocr_detection"), ("Detecting bboxes", "bbox"), ("Recognizing Text", "text"), ("Recognizing tables", "tables")]


def failed_step(log: Column, steps: list[tuple[str, str]] = LOG_STEPS) -> Column:
    """The last step of the list whose pattern a log shows."""
    return F.coalesce(*[F.when(log.rlike(f"(?i){p}"), name) for p, name in reversed(steps)])


#: Fixed words of archive members' names by language.
VIETNAMESE_NAMES, ENGLISH_NAMES = ["vi", "vietnamese"], ["en", "english"]
VIETNAMESE_MARKS = ["bao", "cao", "tai", "chinh", "hop", "nhat", "kiem", "toan", "thuyet", "minh", "viet", "nam"]
ENGLISH_MARKS = ["audited", "consolidated", "financial", "statements", "statement", "report", "notes", "note", "english"]
NAMED_LANGUAGE = 10


def language_score(path: Column) -> Column:
    """How much a file's name looks Vietnamese: named languages count ten, each distinct mark one; English ones less."""
    words = F.split(F.lower(F.element_at(F.split(path, "/"), -1)), "[^a-z0-9]+")
    has = lambda names: F.size(F.array_intersect(words, F.array(*map(F.lit, names))))
    named = lambda names: F.when(has(names) > 0, NAMED_LANGUAGE).otherwise(0)
    return named(VIETNAMESE_NAMES) - named(ENGLISH_NAMES) + has(VIETNAMESE_MARKS) - has(ENGLISH_MARKS)


#: Fixed file types of downloads, in the order in which they are tried.
DOWNLOAD_TYPES = [".pdf", ".zip", ".rar", ".7z"]


def download_url(path: Column, base: str) -> Column:
    """A stored path as an address below ``base``; whole addresses stay, and an empty path is empty."""
    own = F.trim(F.coalesce(path, F.lit("")))
    below = F.concat(F.lit(base), F.regexp_replace(own, "^/*(?:(?i:data)/)?", ""))
    return F.when((own == "") | own.rlike("^https?://"), own).otherwise(below)


def download_candidates(ticker: Column, title: Column, path: Column, base: str) -> Column:
    """The addresses to try for a document: its own, and below a folder the usual names of audited statements,
    consolidated ones first where the title says so; only the own one without a firm or a year."""
    own = download_url(path, base)
    folder = F.concat(F.regexp_replace(own, "/+$", ""), F.lit("/"))
    firm, year = F.upper(F.trim(F.coalesce(ticker, F.lit("")))), title_year(title)
    stem = F.concat(folder, firm, F.lit("_Baocaotaichinh_"), year.cast("string"), F.lit("_Kiemtoan"))
    whole = F.lower(strip_accents(F.coalesce(title, F.lit("")), True)).contains("hop nhat")
    names = lambda end: F.array(*[F.concat(stem, F.lit(end + t)) for t in DOWNLOAD_TYPES])
    more = F.when(whole, F.concat(names("_Hopnhat"), names(""))).otherwise(names(""))
    is_file = F.regexp_replace(own, r"^[a-z]+://[^/]*|[?#].*$|/+$", "").rlike(r"[^/]\.[^./]+$")
    return F.when(is_file | (firm == "") | year.isNull(), F.array(own)).otherwise(F.concat(F.array(own), more))


def framework_name(name: Column) -> Column:
    """The one name of a scoring framework; null stays, others are an error."""
    known = F.upper(F.trim(name))
    return F.when(known.isin("PROPER", "PROPER-VN", "PROPER_VN"), "PROPER_VN").when(known == "EDC", "EDC").when(name.isNotNull(), F.raise_error(F.concat(F.lit("unknown framework: "), name)))
