"""Queries of the dashboards, templates and pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dashboards as D
from ..operators import pivots as P
from ..operators import templates as T
from .registry import query

EMBED, INFER = "text-embedding-3-small", "gpt-4.1-mini"
YEAR = "TRY_CAST(regexp_extract(title, '([0-9]{4})', 1) AS INTEGER)"


@query(
    "firm_metrics",
    """
SELECT ticker, year, ROUND(LN(NULLIF(total_assets, 0)), 9) AS size, roa, loa, total_assets FROM (
  SELECT ticker, year, MAX(CASE WHEN ratio_code = 'TOTAL_ASSETS_AQ' THEN value END) AS total_assets, MAX(CASE WHEN ratio_code = 'ROAA_TR_AVG5Q' THEN value END) AS roa,
    MAX(CASE WHEN ratio_code = 'LOANS_TO_ASSET_AQ' THEN value END) AS loa
  FROM (SELECT code AS ticker, TRY_CAST(SUBSTR(report_date, 1, 4) AS INTEGER) AS year, ratio_code, value FROM financial_ratios
    WHERE ratio_code IN ('TOTAL_ASSETS_AQ', 'ROAA_TR_AVG5Q', 'LOANS_TO_ASSET_AQ') AND value IS NOT NULL
    QUALIFY ROW_NUMBER() OVER (PARTITION BY code, SUBSTR(report_date, 1, 4), ratio_code ORDER BY report_date DESC, value DESC) = 1)
  GROUP BY ticker, year)""",
)
def _(v):
    return T.firm_metrics(v.financial_ratios)


def _female(d, field="gender", values="'female', 'nữ', 'nu'"):
    return f"COALESCE((SELECT COUNT(*) FROM json_each(COALESCE({d}, '[]')) j WHERE lower(trim(COALESCE(json_extract_string(j.value, '$.{field}'), ''))) IN ({values})), 0)"


_ITEMS = """
base AS (SELECT DISTINCT ticker, year, model FROM governance_results_hyde2),
dir AS (SELECT * FROM governance_results_hyde2 WHERE item_code = 'GOV_DIRECTORY'),
exe AS (SELECT * FROM governance_results_hyde2 WHERE item_code = 'GOV_EXECUTIVE'),
sup AS (SELECT * FROM governance_results_hyde2 WHERE item_code = 'GOV_SUPERVISORY')"""


@query(
    "gov_board_metrics",
    f"""
WITH {_ITEMS}
SELECT ticker, year, model, {_female('dir.details_json')} AS directory_board_female_members, {_female('exe.details_json')} AS executive_board_female_members,
  {_female('dir.details_json', 'is_independent', "'true', '1', 'yes', 'y', 'co', 'có'")} AS directory_board_independent_members,
  CAST(json_array_length(COALESCE(dir.details_json, '[]')) AS BIGINT) AS directory_board_size, CAST(json_array_length(COALESCE(exe.details_json, '[]')) AS BIGINT) AS executive_board_size,
  CAST(json_array_length(COALESCE(sup.details_json, '[]')) AS BIGINT) AS supervisory_board_committee_size,
  COALESCE(json_extract_string(a.value_json, '$.external_audit_firm'), json_extract_string(a.value_json, '$.external_audit_firm_en')) AS audit_firm
FROM base LEFT JOIN dir USING (ticker, year, model) LEFT JOIN exe USING (ticker, year, model) LEFT JOIN sup USING (ticker, year, model)
LEFT JOIN financial_statement_audit_results a USING (ticker, year, model)""",
)
def _(v):
    return T.board_metrics(v.governance_results_hyde2, v.financial_statement_audit_results)


@query(
    "board_profile",
    f"""
WITH {_ITEMS}, iso AS (SELECT ticker, year, model, MAX(CASE WHEN is_present THEN 1 ELSE 0 END) AS iso FROM proper_vn_results_hyde2 WHERE indicator_code = 'S2_ISO14001' GROUP BY ALL)
SELECT ticker, year, model, CAST(json_array_length(COALESCE(exe.details_json, '[]')) AS BIGINT) AS "EXE_BOARDSIZE", CAST(json_array_length(COALESCE(dir.details_json, '[]')) AS BIGINT) AS "DIR_BOARDSIZE",
  year - first_event_year AS "AGE", COALESCE(iso, 0) AS "ISO", {_female('dir.details_json')} AS "WOMAN", CAST(json_array_length(COALESCE(sup.details_json, '[]')) AS BIGINT) AS "SUPERVISOR",
  {_female('sup.details_json')} AS "SUPERVISOR_WOMAN"
FROM base LEFT JOIN dir USING (ticker, year, model) LEFT JOIN exe USING (ticker, year, model) LEFT JOIN sup USING (ticker, year, model) LEFT JOIN iso USING (ticker, year, model)
LEFT JOIN company_history_summary USING (ticker)""",
)
def _(v):
    return T.board_profile(v.governance_results_hyde2, v.proper_vn_results_hyde2, v.company_history_summary)


_MAXES = lambda code, true, names: ", ".join(f"MAX(CASE WHEN {code} = '{c}' AND {true} THEN 1 ELSE 0 END) AS {n}" for c, n in names.items())
_FLAGS = [*T.PROPER_FLAGS.values(), "proper_present_count", "proper_total_indicators", *T.GHG_FLAGS.values(), "edc_ghg_valid_count", "edc_ghg_total_count"]


@query(
    "carbon_proper",
    f"""
WITH p AS (SELECT ticker, year, model, {_MAXES('indicator_code', 'is_present', T.PROPER_FLAGS)}, COUNT(*) FILTER (is_present) AS proper_present_count, COUNT(*) AS proper_total_indicators FROM proper_vn_results_hyde2 GROUP BY ALL),
g AS (SELECT ticker, year, model, {_MAXES('category_code', 'is_valid', T.GHG_FLAGS)}, COUNT(*) FILTER (is_valid) AS edc_ghg_valid_count, COUNT(*) AS edc_ghg_total_count
  FROM inference_results_hyde2 WHERE category_code IN ({', '.join(f"'{c}'" for c in T.GHG_FLAGS)}) GROUP BY ALL),
b AS (SELECT ticker, year, model FROM p UNION SELECT ticker, year, model FROM g)
SELECT ticker, year, model, {', '.join(f'COALESCE({n}, 0) AS {n}' for n in _FLAGS)} FROM b LEFT JOIN p USING (ticker, year, model) LEFT JOIN g USING (ticker, year, model)""",
)
def _(v):
    return T.carbon_proper(v.proper_vn_results_hyde2, v.inference_results_hyde2)


@query("gov_item_coverage", "SELECT item_code, COUNT(*) AS rows_count, COUNT(DISTINCT ticker) AS ticker_count FROM governance_results_hyde2 GROUP BY item_code")
def _(v):
    return T.item_coverage(v.governance_results_hyde2)


@query("latest_gov_results", "SELECT ticker, year, item_code, model, created_at FROM governance_results_hyde2 ORDER BY created_at DESC, ticker, year, item_code LIMIT 100")
def _(v):
    return T.latest_results(v.governance_results_hyde2)


@query("stock_search", "SELECT code, floor, company_name, c.ticker IS NOT NULL AS added FROM stocks s LEFT JOIN companies c ON s.code = c.ticker WHERE floor = 'HOSE' AND (lower(code) LIKE '%1%' OR lower(company_name) LIKE '%1%') ORDER BY code LIMIT 50")
def _(v):
    return D.stock_search(v.stocks, v.companies, "HOSE", "1")


@query(
    "company_counts",
    """SELECT ticker, floor, company_name, (SELECT COUNT(*) FROM financial_statements f WHERE f.code = c.ticker) AS statements, (SELECT COUNT(*) FROM financial_ratios f WHERE f.code = c.ticker) AS ratios,
  (SELECT COUNT(*) FROM listed_documents f WHERE f.ticker = c.ticker) AS documents, (SELECT COUNT(*) FROM conversion_jobs f WHERE f.ticker = c.ticker) AS jobs, (SELECT COUNT(*) FROM annual_reports f WHERE f.ticker = c.ticker) AS reports
FROM companies c LEFT JOIN stocks s ON s.code = c.ticker""",
)
def _(v):
    facts = {"statements": v.financial_statements, "ratios": v.financial_ratios, "documents": v.listed_documents, "jobs": v.conversion_jobs, "reports": v.annual_reports}
    return D.company_counts(v.companies, v.stocks, facts)


_JOBS = {"edc": "inference_jobs", "proper": "proper_vn_jobs", "gov": "governance_jobs"}


@query(
    "company_targets",
    f"""
WITH r AS (SELECT ticker, COUNT(DISTINCT year) AS report_years FROM annual_reports GROUP BY 1), e AS (SELECT ticker, COUNT(DISTINCT year) AS embedded_years FROM document_embeddings GROUP BY 1),
{', '.join(f"{p}j AS (SELECT ticker, COUNT(*) AS {p}_jobs, COUNT(*) FILTER (status = 'pending') AS {p}_pending, COUNT(*) FILTER (status = 'completed') AS {p}_completed FROM {t} GROUP BY 1)" for p, t in _JOBS.items())}
SELECT s.code AS ticker, c.ticker IS NOT NULL AS in_companies, COALESCE(report_years, 0) AS report_years, COALESCE(embedded_years, 0) AS embedded_years,
  {', '.join(f'COALESCE({p}_{x}, 0) AS {p}_{x}' for p in _JOBS for x in ('jobs', 'pending', 'completed'))}
FROM stocks s LEFT JOIN companies c ON c.ticker = s.code LEFT JOIN r ON r.ticker = s.code LEFT JOIN e ON e.ticker = s.code {' '.join(f'LEFT JOIN {p}j ON {p}j.ticker = s.code' for p in _JOBS)}""",
)
def _(v):
    return D.company_targets(v.stocks.select(F.col("code").alias("ticker")), v.companies, v.annual_reports, v.document_embeddings, {p: getattr(v, t) for p, t in _JOBS.items()})


_STATUS = f"""
base AS (SELECT ticker, year FROM annual_reports UNION SELECT ticker, year FROM financial_statement_reports),
a AS (SELECT ticker, year, COUNT(*) AS c FROM document_embeddings WHERE model = '{EMBED}' GROUP BY ALL), f AS (SELECT ticker, year, COUNT(*) AS c FROM financial_statement_document_embeddings WHERE model = '{EMBED}' GROUP BY ALL),
edc AS (SELECT ticker, year, COUNT(DISTINCT category_code) AS c FROM inference_results_hyde2 WHERE model = '{INFER}' GROUP BY ALL), pr AS (SELECT ticker, year, COUNT(DISTINCT indicator_code) AS c FROM proper_vn_results_hyde2 WHERE model = '{INFER}' GROUP BY ALL),
g AS (SELECT ticker, year, COUNT(DISTINCT item_code) AS c FROM governance_results_hyde2 WHERE model = '{INFER}' AND item_code <> 'GOV_AUDIT' GROUP BY ALL),
au AS (SELECT ticker, year, COUNT(*) AS c FROM financial_statement_audit_results WHERE model = '{INFER}' GROUP BY ALL),
status AS (SELECT ticker, year, COALESCE(a.c, 0) AS annual_emb_chunks, COALESCE(f.c, 0) AS financial_statement_emb_chunks,
  EXISTS (SELECT 1 FROM annual_reports x WHERE x.ticker = base.ticker AND x.year = base.year) AS has_annual, EXISTS (SELECT 1 FROM financial_statement_reports x WHERE x.ticker = base.ticker AND x.year = base.year) AS has_financial_statement,
  COALESCE(edc.c, 0) AS edc_count, COALESCE(pr.c, 0) AS proper_count, COALESCE(g.c, 0) AS gov_count, COALESCE(au.c, 0) AS financial_statement_audit_count
  FROM base LEFT JOIN a USING (ticker, year) LEFT JOIN f USING (ticker, year) LEFT JOIN edc USING (ticker, year) LEFT JOIN pr USING (ticker, year) LEFT JOIN g USING (ticker, year) LEFT JOIN au USING (ticker, year))"""


def _status(v):
    return D.processing_status(
        v.annual_reports, v.financial_statement_reports, v.document_embeddings, v.financial_statement_document_embeddings, v.inference_results_hyde2, v.proper_vn_results_hyde2, v.governance_results_hyde2, v.financial_statement_audit_results, EMBED, INFER
    )


@query("processing_status", f"WITH {_STATUS} SELECT * FROM status")
def _(v):
    return _status(v)


@query(
    "work_scope",
    f"""WITH {_STATUS}, ok AS (SELECT *, NOT has_annual OR (annual_emb_chunks > 0 AND edc_count >= 18 AND proper_count >= 7 AND gov_count >= 4) AS aok,
  NOT has_financial_statement OR (financial_statement_emb_chunks > 0 AND financial_statement_audit_count >= 1) AS fok FROM status)
SELECT ticker, year, has_annual AND annual_emb_chunks = 0 AS needs_embedding, has_financial_statement AND financial_statement_emb_chunks = 0 AS needs_financial_statement_embedding,
  has_annual AND annual_emb_chunks > 0 AND edc_count < 18 AS needs_edc, has_annual AND annual_emb_chunks > 0 AND proper_count < 7 AS needs_proper, has_annual AND annual_emb_chunks > 0 AND gov_count < 4 AS needs_governance,
  has_financial_statement AND financial_statement_emb_chunks > 0 AND financial_statement_audit_count < 1 AS needs_financial_statement_audit, aok AND fok AS fully_processed, NOT (aok AND fok) AS any_unprocessed FROM ok""",
)
def _(v):
    names = ["needs_embedding", "needs_financial_statement_embedding", "needs_edc", "needs_proper", "needs_governance", "needs_financial_statement_audit", "fully_processed", "any_unprocessed"]
    return D.with_scopes(_status(v)).select("ticker", "year", *names)


def _exists(table, extra="", year="year"):
    return f"EXISTS (SELECT 1 FROM {table} x WHERE x.ticker = u.ticker AND {year} = u.year {extra})"


_X = YEAR.replace("title", "x.title")


@query(
    "job_matrix",
    f"""
WITH u AS (SELECT ticker, year FROM annual_reports UNION SELECT ticker, {YEAR} AS year FROM listed_documents UNION SELECT ticker, year FROM conversion_jobs UNION SELECT ticker, year FROM document_embeddings)
SELECT ticker, year, {_exists('listed_documents', "AND doc_type = '2'", _X)} AS annual_listed, {_exists('listed_documents', "AND doc_type = '1'", _X)} AS financial_statement_listed,
  {_exists('listed_documents', "AND doc_type = '2' AND synced_to_raw", _X)} AS annual_downloaded, {_exists('listed_documents', "AND doc_type = '1' AND synced_to_raw", _X)} AS financial_statement_downloaded,
  {_exists('conversion_jobs', "AND status = 'completed'")} AS converted, {_exists('annual_reports')} AS loaded, {_exists('document_embeddings')} AS embedded,
  {_exists('inference_jobs', "AND status = 'completed'")} AS edc_done, {_exists('proper_vn_jobs', "AND status = 'completed'")} AS proper_done, {_exists('governance_jobs', "AND status = 'completed'")} AS governance_done
FROM u WHERE ticker IS NOT NULL AND ticker <> '' AND year BETWEEN 1996 AND 2000""",
)
def _(v):
    jobs = {"edc": v.inference_jobs, "proper": v.proper_vn_jobs, "governance": v.governance_jobs}
    return D.job_matrix(v.listed_documents, v.conversion_jobs, v.annual_reports, v.document_embeddings, jobs, 1996, 2000)


@query("tickers_without_jobs", f"SELECT DISTINCT ticker, {YEAR} AS year FROM listed_documents d WHERE doc_type = '2' AND {YEAR} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM conversion_jobs c WHERE c.ticker = d.ticker AND c.year = {YEAR})")
def _(v):
    return D.tickers_without_jobs(v.listed_documents, v.conversion_jobs)


_GAP = f"""
t AS (SELECT ticker FROM companies UNION SELECT ticker FROM annual_reports UNION SELECT ticker FROM conversion_jobs UNION SELECT ticker FROM listed_documents),
d AS (SELECT ticker, MAX({YEAR}) AS y FROM listed_documents GROUP BY 1), j AS (SELECT ticker, MAX(year) AS y FROM conversion_jobs GROUP BY 1), l AS (SELECT ticker, MAX(year) AS y FROM annual_reports GROUP BY 1),
e AS (SELECT t.ticker, GREATEST(COALESCE(d.y, 0), COALESCE(j.y, 0)) AS expected_latest_year, COALESCE(l.y, 0) AS loaded_latest_year FROM t LEFT JOIN d USING (ticker) LEFT JOIN j USING (ticker) LEFT JOIN l USING (ticker)),
gap AS (SELECT e.*, c.status AS expected_job_status, c.source_path AS expected_source_path FROM e LEFT JOIN conversion_jobs c ON c.ticker = e.ticker AND c.year = e.expected_latest_year WHERE expected_latest_year > 0)"""


@query("report_gap", f"WITH {_GAP} SELECT * FROM gap")
def _(v):
    return D.report_gap(v.companies, v.listed_documents, v.conversion_jobs, v.annual_reports)


@query(
    "gap_flags",
    f"WITH {_GAP} SELECT *, TRUE AS is_missing, expected_latest_year AS missing_year, COALESCE(expected_source_path, '') <> '' AS has_source FROM gap WHERE ticker LIKE '%1%' AND loaded_latest_year < expected_latest_year",
)
def _(v):
    return D.gap_flags(D.report_gap(v.companies, v.listed_documents, v.conversion_jobs, v.annual_reports), "1", True)


@query("report_pairs", "SELECT DISTINCT ticker, year FROM document_embeddings INTERSECT SELECT ticker, year FROM financial_statement_document_embeddings")
def _(v):
    return D.report_pairs(v.document_embeddings, v.financial_statement_document_embeddings)


_LINES = """l AS (SELECT m.item_code, m.model_type, COALESCE(NULLIF(item_en_name, ''), item_vn_name) AS label, display_order, display_level, fiscal_date, numeric_value
  FROM financial_models m LEFT JOIN financial_statements f ON f.item_code = m.item_code AND f.model_type = m.model_type AND f.code = 'T7' AND f.report_type = 'ANNUAL' WHERE m.model_type = '2.0')"""


@query("statement_join", f"WITH {_LINES} SELECT * FROM l")
def _(v):
    return D.statement_lines(v.financial_models, v.financial_statements, "T7", "2.0")


@query("statement_pivot", f"WITH {_LINES} SELECT item_code, label, display_order, {', '.join(f'first(numeric_value ORDER BY fiscal_date DESC, numeric_value DESC NULLS LAST) FILTER (fiscal_date LIKE {chr(39)}{y}%{chr(39)}) AS y{y}' for y in range(1995, 2002))} FROM l GROUP BY ALL")
def _(v):
    return P.statement_pivot(D.statement_lines(v.financial_models, v.financial_statements, "T7", "2.0"), list(range(1995, 2002)))


@query(
    "ratio_pivot",
    f"""WITH r AS (SELECT COALESCE(NULLIF(ratio_group, ''), 'Other') AS ratio_group, ratio_code, TRY_CAST(SUBSTR(report_date, 1, 4) AS INTEGER) AS year, value FROM financial_ratios WHERE code = 'T7'
  QUALIFY ROW_NUMBER() OVER (PARTITION BY COALESCE(NULLIF(ratio_group, ''), 'Other'), ratio_code, SUBSTR(report_date, 1, 4) ORDER BY report_date DESC, value DESC NULLS LAST) = 1)
SELECT ratio_group, ratio_code, {', '.join(f'MAX(value) FILTER (year = {y}) AS y{y}' for y in range(1995, 2002))} FROM r GROUP BY ALL""",
)
def _(v):
    return P.ratio_pivot(v.financial_ratios, "T7", list(range(1995, 2002)))


_SCORED = """SELECT ticker, year, MIN(CASE length(content) % 5 WHEN 0 THEN 'fail' WHEN 1 THEN 'warning' ELSE 'pass' END) AS quality_status, MAX(length(content) % 700) AS garbled_count,
  MAX(length(content) % 100) / 100.0 AS garbled_ratio, MAX(length(content) % 90) / 90.0 AS suspicious_score, MAX(length(content) % 9) AS broken_spacing_count, MAX(length(content) % 7) / 7.0 AS single_char_ratio
FROM annual_reports GROUP BY ticker, year"""
_WORST = "ORDER BY CASE quality_status WHEN 'fail' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, garbled_count DESC NULLS LAST, garbled_ratio DESC NULLS LAST, suspicious_score DESC NULLS LAST, broken_spacing_count DESC NULLS LAST, single_char_ratio DESC NULLS LAST, ticker, year"


def _scored(v):
    v.annual_reports.createOrReplaceTempView("annual_reports")
    cast = {c: F.col(c).cast("double") for c in ("garbled_ratio", "suspicious_score", "single_char_ratio")}
    return v.spark.sql(_SCORED.replace("100.0", "100.0D").replace("90.0", "90.0D").replace("7.0", "7.0D")).withColumns(cast)


_SCORED_SQL = _SCORED.replace("100.0", "CAST(100 AS DOUBLE)").replace("90.0", "CAST(90 AS DOUBLE)").replace("7.0", "CAST(7 AS DOUBLE)")


@query("force_ocr_candidates", f"WITH s AS ({_SCORED_SQL}) SELECT s.*, j.status AS job_status, j.force_ocr FROM s LEFT JOIN conversion_jobs j USING (ticker, year) WHERE quality_status <> 'pass' {_WORST} LIMIT 200")
def _(v):
    return D.force_ocr_candidates(_scored(v), v.conversion_jobs, limit=200)


@query("rerun_candidates", f"WITH s AS ({_SCORED_SQL}) SELECT s.* FROM s JOIN conversion_jobs j USING (ticker, year) WHERE quality_status = 'fail' ORDER BY suspicious_score DESC NULLS LAST, broken_spacing_count DESC NULLS LAST, single_char_ratio DESC NULLS LAST, ticker, year LIMIT 50")
def _(v):
    return D.rerun_candidates(_scored(v), v.conversion_jobs, 50)


_OUT = "CASE WHEN id % 2 = 0 THEN 'markdown' ELSE 'text' END"


@query(
    "doc_job_status",
    f"""WITH c AS (SELECT ticker, {YEAR} AS year, COUNT(*) AS documents, COUNT(*) FILTER (synced_to_raw) AS synced FROM listed_documents WHERE {YEAR} IS NOT NULL GROUP BY ALL)
SELECT c.*, j.status AS job_status FROM c LEFT JOIN (SELECT *, {_OUT} AS output_dir FROM conversion_jobs) j ON j.ticker = c.ticker AND j.year = c.year AND j.output_dir = 'markdown'""",
)
def _(v):
    return D.document_job_status(v.listed_documents, v.conversion_jobs.withColumn("output_dir", F.expr(_OUT)), "markdown")


@query(
    "duplicate_docs",
    "WITH k AS (SELECT file_info_id, MIN(id) AS keep_id, COUNT(*) AS copies FROM listed_documents WHERE file_info_id IS NOT NULL GROUP BY 1 HAVING COUNT(*) > 1) SELECT d.id, d.file_info_id, keep_id, copies FROM listed_documents d JOIN k USING (file_info_id) WHERE d.id <> keep_id",
)
def _(v):
    return D.duplicate_documents(v.listed_documents)


@query("doc_tracking", "SELECT doc_type, COUNT(*) AS total, COUNT(*) FILTER (synced_to_raw) AS synced, COUNT(*) FILTER (NOT synced_to_raw) AS unsynced, COUNT(DISTINCT ticker) AS tickers, MAX(published_date) AS latest FROM listed_documents GROUP BY 1")
def _(v):
    return D.document_tracking(v.listed_documents)


@query(
    "job_status_counts",
    "SELECT s AS status, COUNT(j.status) AS jobs FROM (VALUES ('pending'), ('running'), ('completed'), ('failed'), ('cancelled')) t(s) LEFT JOIN conversion_jobs j ON j.status = s GROUP BY 1 UNION ALL SELECT 'total', COUNT(*) FROM conversion_jobs",
)
def _(v):
    return D.status_counts(v.conversion_jobs, ["pending", "running", "completed", "failed", "cancelled"])


@query("table_counts", "SELECT 'stocks' AS table_name, COUNT(*) AS rows FROM stocks UNION ALL SELECT 'ratios', COUNT(*) FROM financial_ratios UNION ALL SELECT 'chunks', COUNT(*) FROM document_embeddings")
def _(v):
    return D.table_counts({"stocks": v.stocks, "ratios": v.financial_ratios, "chunks": v.document_embeddings})


@query("latest_doc", "SELECT ticker, id, title, published_date, raw_path FROM listed_documents WHERE doc_type = '2' AND synced_to_raw QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY published_date DESC, id DESC) = 1")
def _(v):
    return D.latest_document(v.listed_documents)


@query("company_sync", "WITH s AS (SELECT DISTINCT upper(code) AS t FROM stocks WHERE floor IN ('HOSE')) SELECT COUNT(*) AS matched, COUNT(*) FILTER (c.ticker IS NULL) AS added, COUNT(c.ticker) AS existing FROM s LEFT JOIN companies c ON c.ticker = t")
def _(v):
    return D.company_sync(v.stocks, v.companies, ["HOSE"])[1]


@query(
    "download_rank",
    f"""WITH d AS (SELECT id, ticker, {YEAR} AS year, published_date, 0 AS score FROM listed_documents)
SELECT id, ticker, year, score, year IS NULL AS no_year, MIN(id) OVER (PARTITION BY ticker, year) AS arrival, CAST(ROW_NUMBER() OVER (PARTITION BY ticker, year ORDER BY score DESC, published_date DESC NULLS LAST, id DESC) AS INTEGER) AS place FROM d""",
)
def _(v):
    return D.download_order(v.listed_documents)


@query(
    "first_event",
    "SELECT ticker, event_year AS first_event_year, event_text AS first_event_text, CASE WHEN event_year IS NOT NULL THEN GREATEST(0, 2026 - event_year) END AS firm_age FROM company_history_events QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY COALESCE(event_year, 9999), event_order) = 1",
)
def _(v):
    return D.first_event(v.company_history_events, 2026)


@query(
    "legacy_merge",
    """SELECT ticker, year, category_code, is_valid, model FROM inference_results_hyde2 UNION ALL SELECT ticker, year, category_code, is_valid, model FROM inference_results l
WHERE NOT EXISTS (SELECT 1 FROM inference_results_hyde2 n WHERE n.ticker = l.ticker AND n.year = l.year AND n.category_code = l.category_code AND n.model = l.model)""",
)
def _(v):
    columns = ["ticker", "year", "category_code", "is_valid", "model"]
    return D.merged(v.inference_results_hyde2.select(columns), v.inference_results.select(columns), ["ticker", "year", "category_code", "model"])


def _part(dataset, table, code, status, extra, reason, created, where=""):
    return f"SELECT '{dataset}' AS dataset, ticker, year, {code} AS item_code, CASE WHEN {status} THEN '1' ELSE '0' END AS status, {extra} AS extra, {reason} AS reason, model, {created} AS created_at FROM {table} {where}"


_EDC, _NONE = ("inference_results_hyde2", "category_code", "is_valid", "''", "reason", "created_at"), "CAST(NULL AS VARCHAR)"
_EXTRACTED = " UNION ALL ".join(
    [
        _part("EDC", *_EDC, "WHERE category_code NOT LIKE '%_alt' AND category_code NOT LIKE '%_alt_two'"),
        _part("EDC_ALT", *_EDC, "WHERE category_code LIKE '%_alt' AND category_code NOT LIKE '%_alt_two'"),
        _part("EDC_ALT_TWO", *_EDC, "WHERE category_code LIKE '%_alt_two'"),
        _part("PROPER_VN", "proper_vn_results_hyde2", "indicator_code", "is_present", "COALESCE(evidence_level, '')", "reason", "created_at"),
        _part("GOVERNANCE", "governance_results_hyde2", "item_code", "found", "COALESCE(SUBSTR(value_json, 1, 160), '')", _NONE, "created_at", "WHERE item_code <> 'GOV_AUDIT'"),
        _part("FINANCIAL_STATEMENT_AUDIT", "financial_statement_audit_results", "COALESCE(audit_firm, '')", "found", "''", _NONE, "CAST(NULL AS TIMESTAMP)"),
    ]
)


def _extracted(v):
    return D.extracted_items(v.inference_results_hyde2, v.proper_vn_results_hyde2, v.governance_results_hyde2, v.financial_statement_audit_results)


@query("extract_items_union", f"SELECT * FROM ({_EXTRACTED}) x")
def _(v):
    return _extracted(v)


@query("report_items", f"SELECT dataset, item_code, status, extra FROM ({_EXTRACTED}) x WHERE ticker = 'T7' AND year = 1997 AND dataset IN ('EDC', 'PROPER_VN', 'GOVERNANCE')")
def _(v):
    return D.report_items(_extracted(v), "T7", 1997, ["EDC", "PROPER_VN", "GOVERNANCE"])


@query("result_filter", "SELECT * FROM proper_vn_results_hyde2 WHERE upper(ticker) = 'T7' AND lower(indicator_code) LIKE '%s2%' AND is_present = TRUE AND lower(COALESCE(reason, '') || ' ' || COALESCE(evidence_level, '')) LIKE '%a%' AND year >= 1996 AND year <= 2000")
def _(v):
    return D.result_filter(v.proper_vn_results_hyde2, "t7", "S2", True, "A", "indicator_code", "is_present", ("reason", "evidence_level"), (1996, 2000))


@query("equal_filters", "SELECT * FROM inference_jobs WHERE ticker IN ('T1', 'T2', 'T3') AND model = 'gpt-4.1-mini'")
def _(v):
    return D.equal_filters(v.inference_jobs, ticker=["T1", "T2", "T3"], year=None, model="gpt-4.1-mini")


_EDC_SET = ", ".join(f"'{c}'" for c in P.EDC_CODES)


@query(
    "edc_wide",
    f"""WITH w AS (SELECT ticker, year, model, {', '.join(f"COALESCE(MAX(CASE WHEN category_code = '{c}' THEN CAST(is_valid AS INTEGER) END), 0) AS {c}" for c in P.EDC_CODES)} FROM inference_results_hyde2 WHERE category_code IN ({_EDC_SET}) GROUP BY ALL)
SELECT *, {' + '.join(P.EDC_CODES)} AS total_score FROM w""",
)
def _(v):
    return P.edc_wide(v.inference_results_hyde2)


@query(
    "edc_group_scores",
    f"""SELECT ticker, year, model, CASE {' '.join(f"WHEN category_code IN ({', '.join(repr(c) for c in codes)}) THEN '{g}'" for g, codes in P.EDC_GROUPS.items())} END AS item_group,
  CAST(SUM(CAST(is_valid AS INTEGER)) AS BIGINT) AS score, COUNT(*) AS items FROM inference_results_hyde2 WHERE category_code IN ({_EDC_SET}) GROUP BY ALL""",
)
def _(v):
    return P.edc_group_scores(v.inference_results_hyde2)


_VERSION = "CASE WHEN category_code LIKE '%\\_alt\\_two%' ESCAPE '\\' THEN 'alt_two' WHEN category_code LIKE '%\\_alt%' ESCAPE '\\' THEN 'alt' ELSE 'standard' END"
_PCT = "COUNT(*) FILTER (is_valid) AS valid, COUNT(*) AS total, ROUND(100.0 * COUNT(*) FILTER (is_valid) / COUNT(*), 1) AS valid_pct"


@query("valid_pct_by_year", f"SELECT year, model, {_VERSION} AS version, {_PCT} FROM inference_results_hyde2 GROUP BY ALL")
def _(v):
    return P.valid_share(v.inference_results_hyde2, ["year", "model", "version"])


@query(
    "edc_variant_compare",
    f"""WITH s AS (SELECT category_code, ROUND(100.0 * COUNT(*) FILTER (is_valid) / COUNT(*), 1) AS standard_pct FROM inference_results WHERE split_part(category_code, '_', 1) IN ({_EDC_SET}) GROUP BY 1),
n AS (SELECT category_code, ROUND(100.0 * COUNT(*) FILTER (is_valid) / COUNT(*), 1) AS variant_pct FROM inference_results_hyde2 GROUP BY 1)
SELECT *, ROUND(variant_pct - standard_pct, 1) AS difference FROM s JOIN n USING (category_code)""",
)
def _(v):
    return P.compare_variants(v.inference_results, v.inference_results_hyde2)


@query(
    "top_ticker_compare",
    """WITH m AS (SELECT ticker, COUNT(*) AS rows, ROUND(100.0 * COUNT(*) FILTER (is_valid) / COUNT(*), 1) AS standard_pct FROM inference_results GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
n AS (SELECT ticker, ROUND(100.0 * COUNT(*) FILTER (is_valid) / COUNT(*), 1) AS variant_pct FROM inference_results_hyde2 GROUP BY 1)
SELECT ticker, rows, standard_pct, COALESCE(variant_pct, 0) AS variant_pct FROM m LEFT JOIN n USING (ticker)""",
)
def _(v):
    return P.compare_top_tickers(v.inference_results, v.inference_results_hyde2)


@query("overall_metrics", "SELECT COUNT(*) AS rows, COUNT(DISTINCT ticker) AS tickers, COUNT(DISTINCT year) AS years, COUNT(DISTINCT category_code) AS categories, ROUND(100.0 * COUNT(*) FILTER (is_valid) / COUNT(*), 1) AS valid_pct FROM inference_results_hyde2")
def _(v):
    return P.overall(v.inference_results_hyde2)


_GOV = ["GOV_DIRECTORY", "GOV_EXECUTIVE", "GOV_SUPERVISORY", "GOV_SHAREHOLDERS"]


@query("gov_found_pivot", f"""SELECT ticker, year, model, {', '.join(f"MAX(CASE WHEN item_code = '{c}' AND found THEN 1 ELSE 0 END) AS {c}" for c in _GOV)} FROM governance_results_hyde2 GROUP BY ALL""")
def _(v):
    return P.found_pivot(v.governance_results_hyde2, _GOV)


@query(
    "gov_item_summary",
    "SELECT item_code, COUNT(*) AS rows, COUNT(*) FILTER (found) AS found_rows, COUNT(DISTINCT ticker) AS distinct_tickers, MIN(year) AS min_year, MAX(year) AS max_year, ROUND(AVG(json_array_length(COALESCE(details_json, '[]'))), 6) AS avg_details_count, ROUND(COUNT(*) FILTER (found) / COUNT(*), 4) AS found_rate FROM governance_results_hyde2 GROUP BY 1",
)
def _(v):
    return P.item_summary(v.governance_results_hyde2)


@query("gender_summary", "SELECT item_code, json_extract_string(j.value, '$.gender') AS gender, COUNT(*) AS rows FROM governance_results_hyde2, json_each(COALESCE(details_json, '[]')) j WHERE json_extract_string(j.value, '$.name') IS NOT NULL GROUP BY ALL")
def _(v):
    return P.gender_summary(v.governance_results_hyde2)


_FIRM = "replace(strip_accents(lower(trim(COALESCE(audit_firm, '')))), 'đ', 'd')"


@query(
    "big4_breakdown",
    f"""WITH f AS (SELECT ticker, {_FIRM} AS f FROM financial_statement_audit_results)
SELECT CASE WHEN f LIKE '%deloitte%' OR f LIKE '%dttl%' THEN 'Deloitte' WHEN (f LIKE '%ernst%' AND f LIKE '%young%') OR ' ' || f || ' ' LIKE '% ey %' THEN 'EY' WHEN f LIKE '%pricewaterhousecoopers%' OR f LIKE '%pwc%' THEN 'PwC' WHEN f LIKE '%kpmg%' THEN 'KPMG'
  ELSE 'Non-Big4/Unknown' END AS label, COUNT(*) AS rows, COUNT(DISTINCT ticker) AS tickers FROM f GROUP BY 1""",
)
def _(v):
    return P.big4_breakdown(v.financial_statement_audit_results)


@query("audit_stats", "SELECT COUNT(*) AS rows, COUNT(DISTINCT ticker) AS tickers, MIN(year) AS min_year, MAX(year) AS max_year, COUNT(*) FILTER (found) AS found_rows FROM financial_statement_audit_results")
def _(v):
    return P.audit_stats(v.financial_statement_audit_results)


@query(
    "async_progress",
    """WITH y AS (SELECT run_id, ticker, year, COUNT(*) AS n, COUNT(*) FILTER (status = 'submitted') AS s, COUNT(*) FILTER (status = 'completed') AS c, COUNT(*) FILTER (status = 'failed') AS f FROM chunk_items GROUP BY ALL),
r AS (SELECT run_id, CAST(SUM(n) AS BIGINT) AS total_items, CAST(SUM(s) AS BIGINT) AS submitted_items, CAST(SUM(c) AS BIGINT) AS completed_items, CAST(SUM(f) AS BIGINT) AS failed_items, COUNT(*) FILTER (c + f = n) AS firm_years_done, COUNT(*) AS firm_years FROM y GROUP BY 1)
SELECT *, CASE WHEN submitted_items > 0 THEN 'running' WHEN completed_items = total_items THEN 'completed' WHEN completed_items > 0 AND failed_items > 0 THEN 'partial_failed' WHEN failed_items > 0 THEN 'failed' ELSE 'pending' END AS run_status,
  ROUND(100.0 * (completed_items + failed_items) / total_items, 6) AS progress_pct FROM r""",
)
def _(v):
    return P.run_progress(v.chunk_items)
