"""The report data model: each table's columns, key, and how old rows get new columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Column groups that tables share, as fixed formats.
_FIRM = "ticker string, year int"
_BATCH = "batch_id string, batch_submitted_at timestamp_ntz, batch_checked_at timestamp_ntz"
_RUN = "started_at timestamp_ntz, completed_at timestamp_ntz, error_message string, created_at timestamp_ntz"
_EVIDENCE = "reason string, top_chunks string, similarities string, model string, created_at timestamp_ntz"
_CHUNK = "chunk_index int, chunk_text string, token_count int, chunk_metadata_json string, embedding array<float>, model string, created_at timestamp_ntz"
_EDC = f"id int, {_FIRM}, category_code string, is_valid boolean, {_EVIDENCE}"
_PROPER = f"id int, {_FIRM}, indicator_code string, is_present boolean, evidence_level string, {_EVIDENCE}"
_GOVERNANCE = f"id int, {_FIRM}, item_code string, found boolean, value_json string, details_json string, {_EVIDENCE}"


def _job(counts: str = "", extra: str = "") -> str:
    return f"id int, {_FIRM}, status string, model string, top_k int, {counts}{_BATCH}, {extra}{_RUN}"


#: Table -> (columns, key).
TABLES: dict[str, tuple[str, list[str]]] = {
    "stocks": ("code string, type string, floor string, status string, company_name string, company_name_eng string, short_name string, listed_date string, delisted_date string, company_id string, tax_code string, isin string", ["code"]),
    "companies": ("ticker string", ["ticker"]),
    "financial_models": ("model_type string, item_code string, model_type_name string, model_vn_desc string, model_en_desc string, company_form string, note string, code_list string, item_vn_name string, item_en_name string, display_order int, display_level int, form_type string", []),
    "financial_statements": ("code string, item_code string, report_type string, model_type string, numeric_value double, fiscal_date string, created_date string, modified_date string", []),
    "financial_ratios": ("code string, ratio_group string, report_date string, item_code string, ratio_code string, item_name string, value double", []),
    "listed_documents": ("id bigint, ticker string, doc_type string, title string, full_name string, source string, published_date string, file_url string, file_info_id bigint, synced_to_raw boolean, raw_path string", ["id"]),
    "annual_reports": (
        f"{_FIRM}, content string, source_file string, quality_checked_at timestamp_ntz, quality_suspicious boolean, suspicious_score double, single_char_token_ratio double, broken_spacing_pattern_count int, average_token_length double, "
        "isolated_diacritic_token_count int, garbled_vietnamese_token_count int, garbled_vietnamese_token_ratio double, affected_line_count int, affected_line_ratio double, affected_region_count int, quality_status string, quality_reason string, "
        "quality_evidence string, created_at timestamp_ntz",
        ["ticker", "year"],
    ),
    "financial_statement_reports": (f"{_FIRM}, content string, source_file string, created_at timestamp_ntz", ["ticker", "year"]),
    "pipeline_files": (f"{_FIRM}, stage string, file_path string, created_at timestamp_ntz", ["ticker", "year", "stage"]),
    "conversion_jobs": (f"id int, {_FIRM}, start_year int, end_year int, source_path string, output_dir string, status string, force_ocr boolean, rerun_reason string, command string, log_path string, pid int, error_message string, failed_step string, started_at timestamp_ntz, completed_at timestamp_ntz, created_at timestamp_ntz", ["ticker", "year"]),
    "document_embeddings": (f"{_FIRM}, {_CHUNK}", ["ticker", "year", "chunk_index"]),
    "financial_statement_document_embeddings": (f"{_FIRM}, {_CHUNK}", ["ticker", "year", "chunk_index"]),
    "financial_statement_audit_jobs": (_job(), ["ticker", "year", "model"]),
    "financial_statement_audit_results": (f"id int, {_FIRM}, found boolean, audit_firm string, audit_opinion string, signing_auditor_names string, value_json string, details_json string, {_EVIDENCE}", ["ticker", "year", "model"]),
    "inference_jobs": (_job("categories_done int, categories_total int, "), ["ticker", "year", "model"]),
    "inference_results": (_EDC, ["ticker", "year", "category_code", "model"]),
    "inference_results_hyde2": (_EDC, ["ticker", "year", "category_code", "model"]),
    "proper_vn_jobs": (_job("indicators_done int, indicators_total int, ", "color string, s2_score int, s2_max_score int, "), ["ticker", "year", "model"]),
    "proper_vn_results": (_PROPER, ["ticker", "year", "indicator_code", "model"]),
    "proper_vn_results_hyde2": (_PROPER, ["ticker", "year", "indicator_code", "model"]),
    "governance_jobs": (_job("items_done int, items_total int, "), ["ticker", "year", "model"]),
    "governance_results": (_GOVERNANCE, ["ticker", "year", "item_code", "model"]),
    "governance_results_hyde2": (_GOVERNANCE, ["ticker", "year", "item_code", "model"]),
    "reference_documents": ("doc_id string, source_file string, title string, content string, content_hash string, updated_at timestamp_ntz", ["doc_id"]),
    "reference_chunks": ("chunk_id string, doc_id string, chunk_index int, chunk_text string, token_count int", ["chunk_id"]),
    "reference_embeddings": ("chunk_id string, model string, dimensions int, embedding array<float>, created_at timestamp_ntz", ["chunk_id"]),
    "reference_retrieval_logs": ("request_id string, query string, framework string, indicator_code string, top_k int, embedding_model string, llm_model string, response_json string, created_at timestamp_ntz", ["request_id"]),
    "llm_model_presets": ("task_type string, model_name string, is_active boolean, created_at timestamp_ntz", ["task_type", "model_name"]),
    "llm_request_inputs": (f"id int, task_type string, {_FIRM}, item_code string, model string, batch_id string, request_body string, prompt_text string, created_at timestamp_ntz", ["id"]),
    "company_history_events": ("ticker string, event_order int, event_year int, event_date string, event_text string, section_name string, fetched_at timestamp_ntz", ["ticker", "event_order"]),
    "company_history_summary": ("ticker string, first_event_year int, first_event_date string, first_event_text string, firm_age int, event_count int, fetched_at timestamp_ntz", ["ticker"]),
    "chunk_metadata_runs": ("run_id string, created_at string, updated_at string, model string, temperature double, prompt_batch_size int, status string, total_items int, submitted_items int, completed_items int, failed_items int", ["run_id"]),
    "chunk_metadata_items": (f"run_id string, {_FIRM}, chunk_index int, batch_id string, custom_id string, status string, attempt_count int, error_message string, updated_at string", ["run_id", "ticker", "year", "chunk_index"]),
}
#: Names that older stores use for a table.
OLD_NAMES = {"broad_reports": "financial_statement_reports", "broad_document_embeddings": "financial_statement_document_embeddings"}
#: What a column that older rows lack reads as.
DEFAULTS = {"synced_to_raw": False, "force_ocr": False, "quality_suspicious": False, "status": "pending", "is_active": True}


def schema_of(table: str) -> StructType:
    return StructType.fromDDL(TABLES[OLD_NAMES.get(table, table)][0])


def key_of(table: str) -> list[str]:
    return TABLES[OLD_NAMES.get(table, table)][1]


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema_of(table))


def evolved(df: DataFrame, table: str) -> DataFrame:
    """Rows of an older layout in the present one: missing columns added, defaults filled, types cast."""
    out = []
    for field in schema_of(table):
        value = F.col(field.name).try_cast(field.dataType) if field.name in df.columns else F.lit(None).cast(field.dataType)
        if field.name in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[field.name]))
        out.append(value.alias(field.name))
    return df.select(*out)
