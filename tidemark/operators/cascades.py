"""Cascades over the store's tables: what goes, or starts again, with a firm or a firm-year, as one declared graph.

A rule names a table, how its columns meet those of a request, and what happens to the rows that meet: they go, or some
of their columns change.  Each table is read once: the rows are marked by a join with the requests, counted by an
observation while the outcome is written as the table's next version, and never scanned for the count alone.  A table
without a rule isn't touched.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import settle
from ..sources.files import Store
from .state import upsert


#: Tables that are written at once.
AT_ONCE = 6


@dataclass(frozen=True)
class Rule:
    """``keys``: column of the request -> column of the table; ``sets``: SQL of columns of rows that stay, none: they go."""

    table: str
    keys: tuple[tuple[str, str], ...]
    sets: dict[str, str] = field(default_factory=dict)


#: Tables that name a firm otherwise.
FIRM_COLUMN = {"financial_ratios": "code", "financial_statements": "code"}


def _by(table: str, *keys: str, **sets: str) -> Rule:
    return Rule(table, tuple((k, FIRM_COLUMN.get(table, k)) for k in keys), sets)


#: Tables that hold rows of a firm which go with it; embeddings and results of reports stay, as in the store's rules.
FIRM = [
    _by(t, "ticker")
    for t in (
        "company_history_events", "company_history_summary", "conversion_jobs", "annual_reports", "financial_statement_reports", "pipeline_files",
        "financial_statement_document_embeddings", "financial_statement_audit_results", "listed_documents", "financial_ratios", "financial_statements", "companies",
    )
]

_WAITING = {"status": "'pending'", **{c: "NULL" for c in ("batch_id", "batch_submitted_at", "batch_checked_at", "started_at", "completed_at", "error_message")}}

#: What follows from a report: derived rows go, jobs start again.
DOWNSTREAM = [_by(t, "ticker", "year") for t in ("annual_reports", "document_embeddings", "inference_results", "proper_vn_results", "governance_results")] + [
    _by("inference_jobs", "ticker", "year", **_WAITING, categories_done="0"),
    _by("proper_vn_jobs", "ticker", "year", **_WAITING, indicators_done="0", color="NULL", s2_score="NULL", s2_max_score="NULL"),
    _by("governance_jobs", "ticker", "year", **_WAITING, items_done="0"),
]


def after(rows: DataFrame, requests: DataFrame, rule: Rule, seen: Observation | None = None) -> DataFrame:
    """``rows`` after the rule; ``seen`` gets (hit, total) when the outcome is computed.  Null keys meet nothing."""
    names = [f"c_{of_request}" for of_request, _ in rule.keys]
    wanted = requests.select(*[F.col(a).alias(n) for n, (a, _) in zip(names, rule.keys)]).distinct().withColumn("c_hit", F.lit(True))
    met = [F.col(of_table) == F.col(n) for n, (_, of_table) in zip(names, rule.keys)]
    marked = rows.join(wanted, met, "left")
    hit = F.coalesce("c_hit", F.lit(False))
    if seen is not None:
        marked = marked.observe(seen, F.count_if(hit).alias("hit"), F.count("*").alias("total"))
    if not rule.sets:
        return marked.where(~hit).select(*rows.columns)
    changed = lambda c: F.when(hit, F.expr(rule.sets[c]).cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in rule.sets else F.col(c)
    return marked.select(*[changed(c) for c in rows.columns])


def cascade(store: Store, requests: DataFrame, rules: list[Rule]) -> dict[str, tuple[int, int]]:
    """Write each table's next version, some at once; table -> (rows that went or changed, rows before)."""

    def one(rule: Rule) -> tuple[int, int]:
        seen = Observation(rule.table)
        store.write(rule.table, after(store.read(rule.table), requests, rule, seen))
        return seen.get["hit"], seen.get["total"]

    with ThreadPoolExecutor(AT_ONCE) as pool:
        return dict(zip([r.table for r in rules], pool.map(one, rules)))


def delete_companies(store: Store, tickers: DataFrame) -> dict[str, tuple[int, int]]:
    """Firms (ticker, in any case) and their rows in all tables of ``FIRM``."""
    return cascade(store, tickers.select(F.upper("ticker").alias("ticker")), FIRM)


def rerun_sources(requests: DataFrame, jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """(ticker, year, source_path): the job's own file, else the newest downloaded document of the title's year, else null."""
    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    year = F.regexp_extract("title", r"(\d{4})", 1).try_cast("int")
    newest = documents.where(F.col("synced_to_raw") & filled("raw_path")).groupBy("ticker", year.alias("year"))
    newest = newest.agg(F.max_by("raw_path", F.struct(F.coalesce("published_date", F.lit("")), "id")).alias("raw_path"))
    own = jobs.where(filled("source_path")).groupBy("ticker", "year").agg(F.min("source_path").alias("own_path"))
    wanted = requests.select(F.upper("ticker").alias("ticker"), "year").distinct().where("ticker <> '' AND year IS NOT NULL")
    return wanted.join(own, ["ticker", "year"], "left").join(newest, ["ticker", "year"], "left").select("ticker", "year", F.coalesce("own_path", "raw_path").alias("source_path"))


def reset_downstream(store: Store, requests: DataFrame, reason: str, output_dir: str = "markdown") -> tuple[dict[str, tuple[int, int]], DataFrame]:
    """Firm-years again from their source files: their jobs are pending and what followed is gone.

    Gives the counts and the firm-years without a file, which are left as they are.
    """
    jobs = store.read("conversion_jobs")
    found = settle(rerun_sources(requests, jobs, store.read("listed_documents")))  # each rule asks for it
    ready = found.where("source_path IS NOT NULL")
    fresh: dict[str, Column] = {"start_year": F.col("year"), "end_year": F.col("year"), "output_dir": F.lit(output_dir), "status": F.lit("pending"), "rerun_reason": F.lit(reason)}
    kept = jobs.select("ticker", "year", *[c for c in ("id", "created_at", "force_ocr") if c in jobs.columns])
    rows = ready.join(kept, ["ticker", "year"], "left").withColumns(fresh)
    again = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(jobs.schema[c].dataType).alias(c) for c in jobs.columns])
    counts = cascade(store, ready, DOWNSTREAM)
    store.write("conversion_jobs", upsert(jobs, again, ["ticker", "year"]))
    return counts, found.where("source_path IS NULL").select("ticker", "year")
