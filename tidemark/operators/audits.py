"""Quality evidence of report texts, and audits that write only what has changed.

Evidence names the first lines that a rule hits, with what it found and a snippet.  Which lines are hit is told by
counts per line; the words themselves are looked for again only in those few lines, so the work on a long text stays
that of one pass.

A re-audit scores every report once, compares a hash of what it found with that of the stored row, and overwrites only
the partitions that hold a changed row; counts are taken by an observation in the scoring pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import break_tags
from ..session import settle
from .documents import GARBLED_RATIO, LINE_BREAK, SPACED_COUNT, audit_order, content_checks, garbled_words, quality, spaced_matches, tokens

#: Examples of a rule, words of an example, characters of a snippet, as fixed values.
EXAMPLES, WORDS, SNIPPET = 5, 5, 120


def snippet(line: Column) -> Column:
    """A line without white space at its ends, cut to 120 characters with dots."""
    text = F.regexp_replace(line, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return F.when(F.length(text) > SNIPPET, F.concat(F.substring(text, 1, SNIPPET - 3), F.lit("..."))).otherwise(text)


def _examples(hits: str, what: Callable[[Column], Column]) -> Column:
    """'L3: found | snippet' of the first lines with a hit, as one text."""
    line = lambda i: F.get("e_lines", i - 1)
    return F.array_join(F.transform(F.slice(hits, 1, EXAMPLES), lambda i: F.concat(F.lit("L"), i.cast("string"), F.lit(": "), what(line(i)), F.lit(" | "), snippet(line(i)))), " ; ")


def _numbered(hit: Callable[[Column], Column]) -> Column:
    return F.array_compact(F.transform("e_lines", lambda x, i: F.when(hit(x), i + 1)))


def _lines(text_column: str) -> Column:
    return F.split(F.coalesce(F.col(text_column), F.lit("")), LINE_BREAK, -1)


def lines_with(rows: DataFrame, text_column: str, hit: Callable[[Column], Column], what: Callable[[Column], Column]) -> DataFrame:
    """``rows`` with ``hits`` (line numbers from 1, over all kinds of breaks) of any rule and ``examples`` of the first."""
    out = rows.withColumn("e_lines", _lines(text_column)).withColumn("hits", _numbered(hit))
    return out.withColumn("examples", _examples("hits", what)).drop("e_lines")


def with_evidence(reports: DataFrame, text_column: str = "content", all_rules: bool = False) -> DataFrame:
    """``reports`` with ``quality_evidence``: up to five lines of each rule that a text breaks (or of all rules hit).

    A null text has none; a line that is hit twice counts once; words of an example are named once each.
    """
    breaks = {"broken_spacing": F.lit(True), "garbled": F.lit(True)}
    if not all_rules:
        breaks = {"broken_spacing": F.col("broken_spacing_count") >= SPACED_COUNT, "garbled": F.col("garbled_ratio") >= GARBLED_RATIO}
    rules = {"spaced_lines": (breaks["broken_spacing"], spaced_matches), "garbled_lines": (breaks["garbled"], garbled_words)}
    hits = {h: F.when(broken, _numbered(lambda x, found=found: F.size(found(x)) > 0)).otherwise(F.array().cast("array<int>")) for h, (broken, found) in rules.items()}
    out = reports.withColumn("e_lines", _lines(text_column)).withColumns(hits)  # lines are looked at where a rule is broken
    spaced = _examples("spaced_lines", lambda line: F.get(spaced_matches(line), F.lit(0)))
    garbled = _examples("garbled_lines", lambda line: F.array_join(F.slice(F.array_distinct(garbled_words(line)), 1, WORDS), ", "))
    parts = [F.when(breaks[n] & (F.size(h) > 0), F.concat(F.lit(f"{n}="), e)) for n, h, e in (("broken_spacing", "spaced_lines", spaced), ("garbled", "garbled_lines", garbled))]
    return out.withColumn("quality_evidence", F.concat_ws(" || ", *parts)).drop("e_lines", "spaced_lines", "garbled_lines")


#: Score column -> column of the stored report.
STORED = {
    "suspicious_score": "suspicious_score", "single_char_ratio": "single_char_token_ratio", "broken_spacing_count": "broken_spacing_pattern_count", "average_token_length": "average_token_length",
    "isolated_diacritic_count": "isolated_diacritic_token_count", "garbled_count": "garbled_vietnamese_token_count", "garbled_ratio": "garbled_vietnamese_token_ratio", "affected_line_count": "affected_line_count",
    "affected_line_ratio": "affected_line_ratio", "affected_region_count": "affected_region_count", "quality_status": "quality_status", "quality_reason": "quality_reason", "quality_evidence": "quality_evidence",
}
_RATIOS = ("single_char_token_ratio", "average_token_length", "garbled_vietnamese_token_ratio")


def scored(reports: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, content and the stored quality columns) of reports, by their normalised texts.

    A text without tokens has ratios and lengths of 0.
    """
    plain = reports.select(*keys, break_tags(F.coalesce("content", F.lit(""))).alias("content"))
    out = with_evidence(quality(plain))
    some = F.size(tokens(F.col("content"))) > 0
    found = [(F.when(some, F.col(a)).otherwise(0.0) if b in _RATIOS else F.col(a)).alias(b) for a, b in STORED.items()]
    return out.select(*keys, "content", (F.col("quality_status") != "pass").alias("quality_suspicious"), *found)


def _hash() -> Column:
    """Of what an audit writes."""
    return F.xxhash64(*[F.col(c) for c in ["content", "quality_suspicious", *STORED.values()]])


def reaudit(spark: SparkSession, path: str, keys: list[str], partition: str = "year", sources: DataFrame | None = None, only: Column | None = None) -> dict[str, int]:
    """Score the reports stored under ``path`` (a Parquet table partitioned by ``partition``) again, in place.

    ``keys`` tell its rows apart; ``only`` chooses rows; ``sources`` (source_file, content) are files that replace
    stored texts.  Rows whose texts and scores are as stored keep their time of audit; a partition without a changed
    row is not written.  Gives how many reports were checked, flagged, warned about, failed and changed, and how many
    partitions were written.  A run that breaks off leaves each partition old or new, and the next run goes on.
    """
    table = spark.read.parquet(path)
    chosen = table if only is None else table.where(only)
    if sources is not None:
        files = sources.groupBy("source_file").agg(F.max(F.struct("content")).alias("f"))
        chosen = chosen.join(files, "source_file", "left").withColumn("content", F.coalesce("f.content", "content")).drop("f")
    seen, status = Observation(), F.col("quality_status")
    new = scored(chosen, keys)
    new = new.select(*[F.col(c).cast(table.schema[c].dataType).alias(c) for c in new.columns]).withColumn("new_hash", _hash())
    both = new.join(table.select(*dict.fromkeys([*keys, partition]), _hash().alias("old_hash")), keys).withColumn("changed", F.col("new_hash") != F.col("old_hash"))
    counts = {"checked": F.count("*"), "flagged": F.count_if(status != "pass"), "warnings": F.count_if(status == "warning"), "failed": F.count_if(status == "fail"), "changed": F.count_if("changed")}
    both = both.observe(seen, *[c.cast("long").alias(n) for n, c in counts.items()])
    fresh = settle(both.where("changed").drop("old_hash", "new_hash", "changed"))
    told = {n: int(seen.get[n]) for n in counts} | {"partitions": 0}
    if told["changed"]:
        parts = fresh.select(partition).distinct()
        renamed = fresh.select(*keys, *[F.col(c).alias(f"n_{c}") for c in new.columns if c in table.columns and c not in keys], F.lit(True).alias("hit"))
        touched = table.join(parts, partition, "left_semi").join(renamed, keys, "left")
        now = F.current_timestamp().cast(table.schema["quality_checked_at"].dataType)
        value = lambda c: now if c == "quality_checked_at" else F.col(f"n_{c}")
        rows = [F.when(F.col("hit"), value(c)).otherwise(F.col(c)).alias(c) if f"n_{c}" in renamed.columns or c == "quality_checked_at" else F.col(c) for c in table.columns]
        rewritten = settle(touched.select(*rows))  # read whole before any of it is written
        rewritten.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        told["partitions"] = parts.count()
    return told


#: Columns of an audit's file, in order: column of the file -> column of scored and checked reports.
AUDIT_COLUMNS = {
    "ticker": "ticker", "year": "year", "path": "path", "source": "source", "source_file": "source_file", "quality_status": "quality_status", "suspicious_score": "suspicious_score", "suspicious": "suspicious",
    "suspicious_reason": "quality_reason", "token_count": "token_count", "single_char_token_count": "single_char_count", "single_char_token_ratio": "single_char_ratio", "broken_spacing_pattern_count": "broken_spacing_count",
    "average_token_length": "average_token_length", "isolated_diacritic_token_count": "isolated_diacritic_count", "garbled_vietnamese_token_count": "garbled_count", "garbled_vietnamese_token_ratio": "garbled_ratio",
    "financial_statement_section_count": "section_count", "financial_statement_disclosure_marker_count": "disclosure_count", "affected_line_count": "affected_line_count", "affected_line_ratio": "affected_line_ratio",
    "affected_region_count": "affected_region_count", "quality_evidence": "quality_evidence",
}


def statement_audit(reports: DataFrame) -> DataFrame:
    """The rows of an audit's file for statements (ticker, year, content, and what else of its columns there is), the worst first."""
    rows = content_checks(with_evidence(quality(reports))).withColumn("suspicious", F.col("quality_status") != "pass")
    rows = audit_order(rows)
    return rows.select(*[(F.col(b) if b in rows.columns else F.lit("")).alias(a) for a, b in AUDIT_COLUMNS.items()])
