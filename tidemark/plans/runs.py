"""Queries of model runs, presets, syncs, downloads and audit orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vector as V
from ..operators import documents as D
from ..operators import pivots as P
from ..operators import retrieval as R
from ..operators import runs as M
from ..operators import state as U
from .registry import query

KEYS = "ticker, year, chunk_index"


@query("audit_model_rows", "SELECT model, COUNT(*) AS rows FROM financial_statement_audit_results GROUP BY model")
def _(v):
    return P.rows_by_model(v.financial_statement_audit_results)


@query(
    "run_chunks",
    f"""SELECT {KEYS} FROM stored_chunks WHERE year IN (1995, 1996)
  AND CASE WHEN trim(COALESCE(chunk_metadata_json, '')) = '' THEN 'missing' ELSE COALESCE(json_extract_string(chunk_metadata_json, '$.metadata_source'), 'missing') END <> 'hybrid'""",
)
def _(v):
    return M.chosen_chunks(v.stored_chunks, years=[1995, 1996], replace=True, only_other=True).select("ticker", "year", "chunk_index")


@query(
    "run_submit",
    f"""WITH c AS (SELECT {KEYS}, 'r1-' || ticker || '-' || year || '-' || ((ROW_NUMBER() OVER (PARTITION BY ticker, year ORDER BY chunk_index) - 1) // 8) AS batch_id
  FROM stored_chunks WHERE trim(COALESCE(chunk_metadata_json, '')) = '')
SELECT 'r1' AS run_id, {KEYS}, batch_id, batch_id || '-' || chunk_index AS custom_id, 'submitted' AS status FROM c""",
)
def _(v):
    return M.submitted(M.chosen_chunks(v.stored_chunks), "r1")


_COLLECTED = """c AS (SELECT i.run_id, i.batch_id, i.custom_id, i.ticker, i.year, i.chunk_index,
  CASE WHEN i.status <> 'submitted' THEN i.status WHEN batch_status = 'expired' THEN 'failed' WHEN batch_status <> 'completed' THEN 'submitted' WHEN answer LIKE '{%' THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN i.status <> 'submitted' THEN NULL WHEN batch_status = 'expired' THEN 'batch expired' WHEN batch_status <> 'completed' THEN NULL WHEN answer IS NULL THEN 'no answer'
    WHEN answer NOT LIKE '{%' THEN 'answer is no JSON object' END AS error_message,
  CASE WHEN i.status = 'submitted' AND batch_status = 'completed' AND answer LIKE '{%' THEN answer END AS answer
  FROM run_items i LEFT JOIN run_batches b USING (batch_id) LEFT JOIN run_answers a USING (custom_id))"""


def _collected(v):
    return M.collected(v.run_items, v.run_batches, v.run_answers)


@query("run_collect", f"WITH {_COLLECTED} SELECT * FROM c")
def _(v):
    return _collected(v)


@query(
    "run_review",
    f"""WITH {_COLLECTED} SELECT run_id, COUNT(*) AS total_items, COUNT(*) FILTER (status = 'pending') AS pending_items, COUNT(*) FILTER (status = 'submitted') AS submitted_items,
  COUNT(*) FILTER (status = 'completed') AS completed_items, COUNT(*) FILTER (status = 'failed') AS failed_items,
  CASE WHEN COUNT(*) FILTER (status IN ('pending', 'submitted')) > 0 THEN 'running' ELSE 'completed' END AS run_status FROM c GROUP BY run_id""",
)
def _(v):
    return M.reviewed(_collected(v))


@query(
    "run_waiting",
    """SELECT ticker, year, chunk_index, chunk_text FROM financial_statement_document_embeddings JOIN run_items USING (ticker, year, chunk_index)
  WHERE run_id = 'run0' AND batch_id = 'batch3' AND status = 'submitted'""",
)
def _(v):
    return M.waiting_chunks(v.financial_statement_document_embeddings, v.run_items, "run0", "batch3")


@query("metadata_backfill")
def _(v):
    texts = v.documents.select("doc_id", F.col("text").alias("chunk_text"))
    return M.backfilled(v.stored_chunks.join(texts, F.col("vec_id") == F.col("doc_id"))).select("ticker", "year", "chunk_index", "chunk_metadata_json")


@query(
    "preset_upsert",
    """WITH new AS (SELECT * FROM (VALUES ('embedding', 'model-10'), ('embedding', 'model-2'), ('embedding', 'fresh')) t(task_type, model_name))
SELECT COALESCE(p.task_type, n.task_type) AS task_type, COALESCE(p.model_name, n.model_name) AS model_name, n.model_name IS NOT NULL OR p.is_active AS is_active
FROM model_presets p FULL JOIN new n ON p.task_type = n.task_type AND p.model_name = n.model_name""",
)
def _(v):
    return M.with_presets(v.model_presets, "embedding", ["model-10", " model-2", "fresh"]).drop("created_at")


@query("preset_list", "SELECT model_name FROM model_presets WHERE task_type = 'inference' AND is_active")
def _(v):
    return M.active_presets(v.model_presets, "inference")


@query(
    "checklist_merge",
    f"""WITH c AS (SELECT * FROM (VALUES {', '.join(f"('{g}', '{x}')" for g, codes in P.EDC_GROUPS.items() for x in codes)}) t(item_group, code))
SELECT item_group, code, ticker, year, is_valid FROM c LEFT JOIN inference_results_hyde2 r ON r.category_code = c.code""",
)
def _(v):
    return P.checklist_results(v.inference_results_hyde2).select("item_group", "code", "ticker", "year", "is_valid")


@query("sync_targets", "SELECT code FROM stocks WHERE code NOT IN (SELECT code FROM financial_statements)")
def _(v):
    return U.sync_targets(v.stocks, v.financial_statements).select("code")


@query("sync_requests", "SELECT ticker, CAST(y AS INTEGER) AS year FROM companies, range(2019, 2024) t(y)")
def _(v):
    return U.sync_requests(v.companies, 2019, 2023)


_PATHS = """CASE id % 5 WHEN 0 THEN CONCAT('/data/fs/', CAST(id AS STRING), '.pdf') WHEN 1 THEN CONCAT('https://files.example.org/', CAST(id AS STRING), '/') WHEN 2 THEN CONCAT('fs/', CAST(id AS STRING)) WHEN 3 THEN '' ELSE CONCAT('Data/v1.2/', CAST(id AS STRING)) END"""
_TITLES = "CASE id % 3 WHEN 0 THEN CONCAT(title, ' Hợp Nhất') ELSE title END"
_STEM = "rtrim(url, '/') || '/' || ticker || '_Baocaotaichinh_' || regexp_extract(title, '[0-9]{4}') || '_Kiemtoan'"
_NAMES = lambda end: ", ".join(f"{_STEM} || '{end}{t}'" for t in X.DOWNLOAD_TYPES)


@query(
    "download_candidates",
    f"""WITH p AS (SELECT id, ticker, {_TITLES} AS title, {_PATHS} AS path FROM listed_documents),
u AS (SELECT *, CASE WHEN path = '' OR path LIKE 'http%' THEN path ELSE 'https://base.example.org/' || regexp_replace(path, '^/*(data/)?', '', 'i') END AS url FROM p)
SELECT id, array_to_string(CASE WHEN path LIKE '%.pdf' OR NOT regexp_matches(title, '[0-9]{{4}}') THEN [url] WHEN lower(strip_accents(title)) LIKE '%hop nhat%' THEN [url, {_NAMES('_Hopnhat')}, {_NAMES('')}] ELSE [url, {_NAMES('')}] END, ' ') AS urls FROM u""",
)
def _(v):
    rows = v.listed_documents.select("id", "ticker", F.expr(_TITLES).alias("title"), F.expr(_PATHS).alias("path"))
    found = X.download_candidates(F.col("ticker"), F.col("title"), F.col("path"), "https://base.example.org/")
    return rows.select("id", F.array_join(found, " ").alias("urls"))


_MEMBER = """CONCAT(CASE id % 4 WHEN 0 THEN 'out/VI_' WHEN 1 THEN 'english/en-' WHEN 2 THEN 'Audited Financial Statements.' ELSE '' END, title, '.pdf')"""
_HAS = lambda words: f"len(list_intersect(w, {words}))"


@query(
    "language_score",
    f"""WITH m AS (SELECT id, {_MEMBER} AS member FROM listed_documents), s AS (SELECT id, regexp_split_to_array(lower(regexp_extract(member, '[^/]*$')), '[^a-z0-9]+') AS w FROM m)
SELECT id, CAST(CASE WHEN {_HAS(X.VIETNAMESE_NAMES)} > 0 THEN 10 ELSE 0 END - CASE WHEN {_HAS(X.ENGLISH_NAMES)} > 0 THEN 10 ELSE 0 END + {_HAS(X.VIETNAMESE_MARKS)} - {_HAS(X.ENGLISH_MARKS)} AS INTEGER) AS score FROM s""",
)
def _(v):
    return v.listed_documents.select("id", X.language_score(F.expr(_MEMBER)).alias("score"))


@query(
    "framework_name",
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'PROPER_VN' WHEN 1 THEN 'EDC' WHEN 2 THEN 'PROPER_VN' END AS framework FROM documents",
)
def _(v):
    return v.documents.select("doc_id", X.framework_name(F.expr("CASE doc_id % 4 WHEN 0 THEN ' proper' WHEN 1 THEN 'Edc' WHEN 2 THEN 'Proper-vn ' END")).alias("framework"))


@query(
    "ocr_need",
    r"""WITH p AS (SELECT conv_id, turn, length(regexp_replace(COALESCE(text, ''), '^\s+|\s+$', '', 'g')) AS size, COUNT(*) OVER (PARTITION BY conv_id) AS n_pages FROM conversations),
q AS (SELECT *, least(5, n_pages) AS taken, n_pages // least(5, n_pages) AS step FROM p)
SELECT conv_id, n_pages, CAST(COALESCE(SUM(size) FILTER (turn % step = 0 AND turn < taken * step), 0) AS BIGINT) AS sampled_chars,
  COALESCE(SUM(size) FILTER (turn % step = 0 AND turn < taken * step), 0) / least(5, n_pages) < 400 AS needs_ocr FROM q GROUP BY conv_id, n_pages""",
)
def _(v):
    return D.needs_ocr(v.conversations, "conv_id", "turn", "text", least=400)


@query("suspicious_reports")
def _(v):
    apart = F.when(F.crc32("source_file") % 5 == 0, F.regexp_replace("content", r"(\S)", "$1 ")).otherwise(F.col("content"))  # a fifth of the texts, letter by letter
    scored = D.suspicious_first(D.quality(v.annual_reports.withColumn("content", apart)))
    return scored.select("ticker", "year", "source_file", F.round("suspicious_score", 9).alias("suspicious_score"), "broken_spacing_count", "quality_status")


@query("audit_order")
def _(v):
    scored = D.audit_order(D.content_checks(D.quality(v.financial_statement_reports)))
    return scored.select("ticker", "year", "quality_status", "garbled_count", F.round("suspicious_score", 9).alias("suspicious_score"))


@query(
    "reference_vectors",
    """SELECT 'c' || e.vec_id AS chunk_id, d.source AS source_file, 'chunk ' || e.vec_id AS chunk_text, CAST(len(e.embedding) AS INTEGER) AS dimensions, ROUND(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS squares, CAST(e.embedding[3] AS DOUBLE) AS third
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id // 3 WHERE e.vec_id % 3 <> 0""",
)
def _(v):
    name = F.concat(F.lit("c"), F.col("vec_id"))
    chunks = v.embeddings.select(name.alias("chunk_id"), F.expr("vec_id div 3").alias("doc_id"), F.concat(F.lit("chunk "), F.col("vec_id")).alias("chunk_text"))
    model = F.when(F.col("vec_id") % 3 == 0, "other").otherwise("small")
    vectors = v.embeddings.select(name.alias("chunk_id"), model.alias("model"), "embedding")
    found = R.reference_vectors(v.documents.select("doc_id", F.col("source").alias("source_file")), chunks, vectors, "small")
    return found.select("chunk_id", "source_file", "chunk_text", F.size("embedding").alias("dimensions"), F.round(V.dot(F.col("embedding"), F.col("embedding")), 6).alias("squares"), F.get("embedding", F.lit(2)).cast("double").alias("third"))
