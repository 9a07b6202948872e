"""Coverage, gap and job dashboards: lazy joins and aggregates over the report relations.

Facts are aggregated before they are joined, so a join never multiplies rows, and only the keys of a fact
table are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_quality, title_year

KEY = ["ticker", "year"]


def counted(df: DataFrame, by: list[str] | str, name: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias(name))


def zero(*names: str) -> dict[str, Column]:
    return {n: F.coalesce(F.col(n), F.lit(0)) for n in names}


def left_all(base: DataFrame, parts: list[DataFrame], on) -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, "left"), parts, base)


def flagged(base: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    """``base`` with a flag for each row whose key is among ``keys`` (an existence join)."""
    marked = keys.select(on).distinct().withColumn(name, F.lit(True))
    return base.join(marked, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def equal_filters(df: DataFrame, **equal) -> DataFrame:
    """A scan with equality filters; None leaves a filter out, a list is an IN filter."""
    for column, value in equal.items():
        if isinstance(value, (list, tuple, set)):
            df = df.where(F.col(column).isin(list(value)))
        elif value is not None:
            df = df.where(F.col(column) == value)
    return df


def result_filter(df: DataFrame, ticker=None, code=None, status=None, text=None, code_column="item_code", status_column="found", text_columns=("reason",), years=(None, None)) -> DataFrame:
    """The console's conjunctive filter: equality, case-blind containment, truth, null-safe text, open year range."""
    terms: list[Column] = []
    if ticker:
        terms.append(F.upper("ticker") == ticker.upper())
    if code:
        terms.append(F.lower(code_column).contains(code.lower()))
    if status is not None:
        terms.append(F.col(status_column) == bool(status))
    if text:
        joined = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in text_columns])
        terms.append(F.lower(joined).contains(text.lower()))
    if years[0] is not None:
        terms.append(F.col("year") >= years[0])
    if years[1] is not None:
        terms.append(F.col("year") <= years[1])
    return df.where(reduce(lambda a, b: a & b, terms)) if terms else df


def stock_search(stocks: DataFrame, companies: DataFrame, floor: str, text: str, limit: int = 50) -> DataFrame:
    """Stocks of an exchange whose code or name holds the text, marked if they are tracked."""
    hits = stocks.where((F.col("floor") == floor) & (F.lower("code").contains(text.lower()) | F.lower("company_name").contains(text.lower())))
    return flagged(hits.select("code", "floor", "company_name"), companies.select(F.col("ticker").alias("code")), ["code"], "added").orderBy("code").limit(limit)


def company_counts(companies: DataFrame, stocks: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """Rows of each fact table for each company; a fact's key column is ticker or code."""
    names = stocks.select(F.col("code").alias("ticker"), "floor", "company_name")
    parts = [counted(f.withColumnRenamed("code", "ticker").select("ticker"), "ticker", n) for n, f in facts.items()]
    return left_all(companies.select("ticker"), [names, *parts], "ticker").withColumns(zero(*facts))


def job_counts(jobs: DataFrame, prefix: str) -> DataFrame:
    done = [F.count_if(F.col("status") == s).alias(f"{prefix}_{s}") for s in ("pending", "completed")]
    return jobs.groupBy("ticker").agg(F.count("*").alias(f"{prefix}_jobs"), *done)


def company_targets(targets: DataFrame, companies: DataFrame, reports: DataFrame, embeddings: DataFrame, jobs: dict[str, DataFrame]) -> DataFrame:
    years = [d.groupBy("ticker").agg(F.countDistinct("year").alias(n)) for d, n in ((reports, "report_years"), (embeddings, "embedded_years"))]
    parts = years + [job_counts(j, p) for p, j in jobs.items()]
    numbers = ["report_years", "embedded_years"] + [f"{p}_{x}" for p in jobs for x in ("jobs", "pending", "completed")]
    return left_all(flagged(targets, companies, ["ticker"], "in_companies"), parts, "ticker").withColumns(zero(*numbers))


#: Results that make a firm-year complete, by kind.
TOTALS = {"edc": 18, "proper": 7, "gov": 4, "financial_statement_audit": 1}


def processing_status(annual: DataFrame, statements: DataFrame, annual_chunks: DataFrame, statement_chunks: DataFrame, edc: DataFrame, proper: DataFrame, governance: DataFrame, audits: DataFrame, embed_model: str, infer_model: str) -> DataFrame:
    """Counts and flags of each firm-year with a report."""
    base = annual.select(KEY).union(statements.select(KEY)).distinct()
    distinct = lambda d, c, n: d.where(F.col("model") == infer_model).groupBy(KEY).agg(F.countDistinct(c).alias(n))
    parts = [
        counted(annual_chunks.where(F.col("model") == embed_model), KEY, "annual_emb_chunks"),
        counted(statement_chunks.where(F.col("model") == embed_model), KEY, "financial_statement_emb_chunks"),
        distinct(edc, "category_code", "edc_count"),
        distinct(proper, "indicator_code", "proper_count"),
        distinct(governance.where("item_code <> 'GOV_AUDIT'"), "item_code", "gov_count"),
        counted(audits.where(F.col("model") == infer_model), KEY, "financial_statement_audit_count"),
    ]
    numbers = ["annual_emb_chunks", "financial_statement_emb_chunks", "edc_count", "proper_count", "gov_count", "financial_statement_audit_count"]
    out = flagged(flagged(base, annual, KEY, "has_annual"), statements, KEY, "has_financial_statement")
    return left_all(out, parts, KEY).withColumns(zero(*numbers))


def with_scopes(status: DataFrame) -> DataFrame:
    """A flag for each work scope of a firm-year."""
    c = F.col
    done = {k: c(f"{k}_count") >= n for k, n in TOTALS.items()}
    embedded, fs_embedded = c("annual_emb_chunks") > 0, c("financial_statement_emb_chunks") > 0
    annual_ok = ~c("has_annual") | (embedded & done["edc"] & done["proper"] & done["gov"])
    fs_ok = ~c("has_financial_statement") | (fs_embedded & done["financial_statement_audit"])
    return status.withColumns(
        {
            "needs_embedding": c("has_annual") & ~embedded,
            "needs_financial_statement_embedding": c("has_financial_statement") & ~fs_embedded,
            "needs_edc": c("has_annual") & embedded & ~done["edc"],
            "needs_proper": c("has_annual") & embedded & ~done["proper"],
            "needs_governance": c("has_annual") & embedded & ~done["gov"],
            "needs_financial_statement_audit": c("has_financial_statement") & fs_embedded & ~done["financial_statement_audit"],
            "fully_processed": annual_ok & fs_ok,
            "any_unprocessed": ~(annual_ok & fs_ok),
        }
    )


def job_matrix(documents: DataFrame, conversions: DataFrame, annual: DataFrame, chunks: DataFrame, jobs: dict[str, DataFrame], low: int, high: int) -> DataFrame:
    """Ten stage flags for each firm-year known anywhere; each table is reduced to its keys once."""
    listed = documents.withColumn("year", title_year(F.col("title")))
    in_range = F.col("year").between(low, high)
    listed_flags = {
        "annual_listed": F.col("doc_type") == "2",
        "financial_statement_listed": F.col("doc_type") == "1",
        "annual_downloaded": (F.col("doc_type") == "2") & F.col("synced_to_raw"),
        "financial_statement_downloaded": (F.col("doc_type") == "1") & F.col("synced_to_raw"),
    }
    from_documents = listed.where(in_range).groupBy(KEY).agg(*[F.bool_or(F.coalesce(v, F.lit(False))).alias(k) for k, v in listed_flags.items()])
    from_conversions = conversions.where(in_range).groupBy(KEY).agg(F.bool_or(F.col("status") == "completed").alias("converted"))
    flags = {
        "loaded": annual,
        "embedded": chunks,
        **{f"{k}_done": j.where("status = 'completed'") for k, j in jobs.items()},
    }
    universe = reduce(lambda a, b: a.union(b), [d.where(in_range).select(KEY) for d in (annual, listed, conversions, chunks)]).distinct()
    out = universe.where("ticker is not null and ticker <> ''").join(from_documents, KEY, "left").join(from_conversions, KEY, "left")
    for name, df in flags.items():
        out = flagged(out, df, KEY, name)
    return out.withColumns({n: F.coalesce(n, F.lit(False)) for n in [*listed_flags, "converted"]})


def tickers_without_jobs(documents: DataFrame, conversions: DataFrame) -> DataFrame:
    """Annual report listings (ticker, year) that no conversion job has."""
    listed = documents.where("doc_type = '2'").select("ticker", title_year(F.col("title")).alias("year")).where("year is not null").distinct()
    return listed.join(conversions.select(KEY).distinct(), KEY, "left_anti")


def report_gap(companies: DataFrame, documents: DataFrame, conversions: DataFrame, annual: DataFrame) -> DataFrame:
    """Each firm's latest expected and loaded report year, with the job of the expected year."""
    tickers = reduce(lambda a, b: a.union(b), [d.select("ticker") for d in (companies, annual, conversions, documents)]).distinct()
    latest = lambda d, n: d.groupBy("ticker").agg(F.max("year").alias(n))
    listed = documents.select("ticker", title_year(F.col("title")).alias("year"))
    out = left_all(tickers, [latest(listed, "d"), latest(conversions, "j"), latest(annual, "l")], "ticker")
    expected = F.greatest(F.coalesce("d", F.lit(0)), F.coalesce("j", F.lit(0)))
    out = out.select("ticker", expected.alias("expected_latest_year"), F.coalesce("l", F.lit(0)).alias("loaded_latest_year")).where("expected_latest_year > 0")
    job = conversions.select("ticker", F.col("year").alias("expected_latest_year"), F.col("status").alias("expected_job_status"), F.col("source_path").alias("expected_source_path"))
    return out.join(job, ["ticker", "expected_latest_year"], "left")


def gap_flags(gap: DataFrame, ticker: str = "", only_missing: bool = False) -> DataFrame:
    """Report gaps as shown: missing flag and year, whether a source exists, filters applied."""
    missing = F.col("loaded_latest_year") < F.col("expected_latest_year")
    out = gap.withColumns({"is_missing": missing, "missing_year": F.when(missing, F.col("expected_latest_year")), "has_source": F.coalesce("expected_source_path", F.lit("")) != ""})
    out = out.where(F.col("ticker").contains(ticker)) if ticker else out
    return out.where("is_missing") if only_missing else out


def report_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Firm-years with chunks in both tables."""
    return first.select(KEY).distinct().join(second.select(KEY).distinct(), KEY, "left_semi")


def statement_lines(models: DataFrame, statements: DataFrame, code: str, model_type: str) -> DataFrame:
    """All line items of a model with a firm's values; items without values stay."""
    values = statements.where((F.col("code") == code) & (F.col("report_type") == "ANNUAL")).select("item_code", "model_type", "fiscal_date", "numeric_value")
    label = F.coalesce(F.expr("nullif(item_en_name, '')"), "item_vn_name")
    items = models.where(F.col("model_type") == model_type).select("item_code", "model_type", label.alias("label"), "display_order", "display_level")
    return items.join(values, ["item_code", "model_type"], "left")


def force_ocr_candidates(scored: DataFrame, jobs: DataFrame, min_garbled: int | None = None, limit: int | None = None) -> DataFrame:
    """Loaded reports worth another conversion, worst first."""
    chosen = scored.where(F.col("garbled_count") >= min_garbled) if min_garbled is not None else scored.where("quality_status <> 'pass'")
    rank = F.when(F.col("quality_status") == "fail", 0).when(F.col("quality_status") == "warning", 1).otherwise(2)
    order = [rank] + [F.desc_nulls_last(c) for c in ("garbled_count", "garbled_ratio", "suspicious_score", "broken_spacing_count", "single_char_ratio")] + ["ticker", "year"]
    out = chosen.join(jobs.select("ticker", "year", F.col("status").alias("job_status"), "force_ocr"), KEY, "left").orderBy(*order)
    return out.limit(limit) if limit else out


def rerun_candidates(scored: DataFrame, jobs: DataFrame, limit: int) -> DataFrame:
    """Failed reports that have a conversion job, worst first."""
    order = [F.desc_nulls_last(c) for c in ("suspicious_score", "broken_spacing_count", "single_char_ratio")] + ["ticker", "year"]
    return scored.where("quality_status = 'fail'").join(jobs.select(KEY), KEY).orderBy(*order).limit(limit)


def document_job_status(documents: DataFrame, jobs: DataFrame, output: str) -> DataFrame:
    """Listed firm-years with counts of documents and the status of the job that writes to ``output``."""
    listed = documents.withColumn("year", title_year(F.col("title"))).where("year is not null")
    counts = listed.groupBy(KEY).agg(F.count("*").alias("documents"), F.count_if("synced_to_raw").alias("synced"))
    return counts.join(jobs.where(F.col("output_dir") == output).select("ticker", "year", F.col("status").alias("job_status")), KEY, "left")


def duplicate_documents(documents: DataFrame) -> DataFrame:
    """Documents to delete: another of the same file has a smaller id."""
    files = documents.where("file_info_id is not null")
    least = files.groupBy("file_info_id").agg(F.min("id").alias("keep_id"), F.count("*").alias("copies")).where("copies > 1")
    return files.join(least, "file_info_id").where("id <> keep_id").select("id", "file_info_id", "keep_id", "copies")


def document_tracking(documents: DataFrame) -> DataFrame:
    synced = F.coalesce("synced_to_raw", F.lit(False))
    return documents.groupBy("doc_type").agg(
        F.count("*").alias("total"), F.count_if(synced).alias("synced"), F.count_if(~synced).alias("unsynced"), F.countDistinct("ticker").alias("tickers"), F.max("published_date").alias("latest")
    )


def status_counts(jobs: DataFrame, statuses: list[str]) -> DataFrame:
    """Jobs by status, none missing, with a total row."""
    spark = jobs.sparkSession
    names = spark.createDataFrame([(s,) for s in statuses], "status string")
    counts = names.join(counted(jobs, "status", "jobs"), "status", "left").withColumns(zero("jobs"))
    return counts.unionByName(jobs.agg(F.count("*").alias("jobs")).withColumn("status", F.lit("total")))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    rows = [d.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, d in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


def latest_document(documents: DataFrame) -> DataFrame:
    """Each firm's latest synced annual report."""
    synced = documents.where("doc_type = '2' and synced_to_raw")
    best = F.struct("published_date", "id")
    return synced.groupBy("ticker").agg(F.max_by(F.struct("id", "title", "published_date", "raw_path"), best).alias("d")).select("ticker", "d.*")


def company_sync(stocks: DataFrame, companies: DataFrame, floors: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(companies after the sync, one row: matched, added, existing)."""
    chosen = equal_filters(stocks, floor=floors).select(F.upper("code").alias("ticker")).where("ticker is not null").distinct()
    new = chosen.join(companies, "ticker", "left_anti")
    report = flagged(chosen, companies, ["ticker"], "known").agg(F.count("*").alias("matched"), F.count_if(~F.col("known")).alias("added"), F.count_if("known").alias("existing"))
    return companies.select("ticker").unionByName(new), report


def download_order(documents: DataFrame) -> DataFrame:
    """Documents in download order: firm-years as they first come, best title first in each, no year last."""
    dated = documents.withColumns({"year": title_year(F.col("title")), "score": title_quality(F.col("title"))})
    group = Window.partitionBy(*KEY)
    within = group.orderBy(F.desc("score"), F.desc_nulls_last("published_date"), F.desc("id"))
    return dated.withColumns({"no_year": F.col("year").isNull(), "arrival": F.min("id").over(group), "place": F.row_number().over(within)}).select("id", "ticker", "year", "score", "no_year", "arrival", "place")


def first_event(events: DataFrame, this_year: int) -> DataFrame:
    """Each firm's earliest event and its age."""
    best = F.struct(F.coalesce("event_year", F.lit(9999)), "event_order")
    out = events.groupBy("ticker").agg(F.min_by(F.struct("event_year", "event_order", "event_text"), best).alias("e"))
    age = F.when(F.col("e.event_year").isNotNull(), F.greatest(F.lit(0), F.lit(this_year) - F.col("e.event_year")))
    return out.select("ticker", F.col("e.event_year").alias("first_event_year"), F.col("e.event_text").alias("first_event_text"), age.alias("firm_age"))


def merged(new: DataFrame, legacy: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and legacy rows whose key is not among them."""
    return new.unionByName(legacy.join(new.select(keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def _branch(df: DataFrame, dataset: str, code: Column, status: Column, extra: Column) -> DataFrame:
    reason = F.col("reason") if "reason" in df.columns else F.lit(None).cast("string")
    created = F.col("created_at") if "created_at" in df.columns else F.lit(None).cast("timestamp_ntz")
    return df.select(F.lit(dataset).alias("dataset"), "ticker", "year", code.alias("item_code"), F.when(status, "1").otherwise("0").alias("status"), extra.alias("extra"), reason.alias("reason"), "model", created.alias("created_at"))


def extracted_items(edc: DataFrame, proper: DataFrame, governance: DataFrame, audits: DataFrame) -> DataFrame:
    """All result tables as one list; codes are split by their suffix as LIKE patterns read it."""
    code, none = F.col("category_code"), F.lit("")
    alt, two = code.like("%_alt"), code.like("%_alt_two")
    parts = [
        _branch(edc.where(~alt & ~two), "EDC", code, F.col("is_valid"), none),
        _branch(edc.where(alt & ~two), "EDC_ALT", code, F.col("is_valid"), none),
        _branch(edc.where(two), "EDC_ALT_TWO", code, F.col("is_valid"), none),
        _branch(proper, "PROPER_VN", F.col("indicator_code"), F.col("is_present"), F.coalesce("evidence_level", none)),
        _branch(governance.where("item_code <> 'GOV_AUDIT'"), "GOVERNANCE", F.col("item_code"), F.col("found"), F.coalesce(F.substring("value_json", 1, 160), none)),
        _branch(audits, "FINANCIAL_STATEMENT_AUDIT", F.coalesce("audit_firm", none), F.col("found"), none),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def report_items(items: DataFrame, ticker: str, year: int, datasets: list[str]) -> DataFrame:
    """One firm-year's items of some datasets, in order."""
    return items.where((F.col("ticker") == ticker) & (F.col("year") == year) & F.col("dataset").isin(datasets)).select("dataset", "item_code", "status", "extra").orderBy("dataset", "item_code")


def archive_primary(members: DataFrame, share: float = 0.6) -> DataFrame:
    """The best member of each archive: large enough, then best language score, size and name."""
    largest = F.max("size").over(Window.partitionBy("archive"))
    large = members.withColumn("largest", largest).where(F.col("size") >= share * F.col("largest"))
    return large.groupBy("archive").agg(F.max_by("member", F.struct("language_score", "size", "member")).alias("member"), F.count("*").alias("candidates"))


def first_filled(*tables: DataFrame) -> DataFrame:
    """The first table that has a row, else the last; a probe reads one row."""
    return next((t for t in tables[:-1] if not t.isEmpty()), tables[-1])
