"""Report-shaped relations over the driver tables, as SQL that Spark and DuckDB both run unchanged."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import read_table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "stocks": """
SELECT CONCAT('T', CAST(c_custkey AS STRING)) AS code, 'stock' AS type,
  CASE WHEN c_custkey % 3 = 0 THEN 'HOSE' WHEN c_custkey % 3 = 1 THEN 'HNX' ELSE 'UPCOM' END AS floor,
  'listed' AS status, c_name AS company_name, c_mktsegment AS short_name
FROM customer
""",
    "companies": """
SELECT CONCAT('T', CAST(c_custkey AS STRING)) AS ticker FROM customer WHERE c_custkey % 7 <> 0
""",
    "listed_documents": """
SELECT o_orderkey AS id, CONCAT('T', CAST(o_custkey AS STRING)) AS ticker,
  CASE WHEN o_orderkey % 2 = 0 THEN '2' ELSE '1' END AS doc_type,
  CASE WHEN o_orderkey % 11 = 0 THEN 'Bao cao khong ro ky' ELSE CONCAT('Bao cao thuong nien nam ', CAST(year(o_orderdate) AS STRING)) END AS title,
  o_orderpriority AS source, CAST(CAST(o_orderdate AS DATE) AS STRING) AS published_date,
  o_orderkey % 5000 AS file_info_id, o_orderstatus = 'F' AS synced_to_raw,
  CASE WHEN o_orderstatus = 'F' THEN CONCAT('raw/', CAST(o_orderkey AS STRING), '.pdf') END AS raw_path
FROM orders
""",
    "conversion_jobs": """
SELECT MIN(o_orderkey) AS id, CONCAT('T', CAST(o_custkey AS STRING)) AS ticker, CAST(year(o_orderdate) AS INTEGER) AS year,
  CONCAT('raw/', CAST(MIN(o_orderkey) AS STRING), '.pdf') AS source_path,
  CASE WHEN MIN(o_orderkey) % 4 = 0 THEN 'pending' WHEN MIN(o_orderkey) % 4 = 3 THEN 'failed' ELSE 'completed' END AS status,
  MIN(o_orderkey) % 10 = 0 AS force_ocr
FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY o_custkey, year(o_orderdate)
""",
    "annual_reports": """
SELECT CONCAT('T', CAST(doc_id % 2003 AS STRING)) AS ticker, CAST(1995 + doc_id % 7 AS INTEGER) AS year,
  text AS content, CONCAT('markdown/', CAST(doc_id AS STRING), '.md') AS source_file
FROM documents
""",
    "document_embeddings": """
SELECT CONCAT('T', CAST(e.label AS STRING)) AS ticker, CAST(1995 + e.vec_id % 3 AS INTEGER) AS year,
  CAST(ROW_NUMBER() OVER (PARTITION BY e.label, e.vec_id % 3 ORDER BY e.vec_id) - 1 AS INTEGER) AS chunk_index,
  d.text AS chunk_text, CAST(16 + e.vec_id % 97 AS INTEGER) AS token_count, e.embedding AS embedding, 'text-embedding-3-small' AS model
FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id % (SELECT COUNT(*) FROM documents)
""",
    "financial_ratios": """
SELECT CONCAT('T', CAST(l_suppkey AS STRING)) AS code, l_returnflag AS ratio_group,
  CAST(CAST(l_shipdate AS DATE) AS STRING) AS report_date,
  CASE WHEN l_linenumber % 4 = 0 THEN 'TOTAL_ASSETS_AQ' WHEN l_linenumber % 4 = 1 THEN 'ROAA_TR_AVG5Q' WHEN l_linenumber % 4 = 2 THEN 'LOANS_TO_ASSET_AQ' ELSE 'OTHER' END AS ratio_code,
  CASE WHEN l_quantity > 45 THEN NULL ELSE l_extendedprice END AS value
FROM lineitem
""",
    "financial_models": """
SELECT CASE WHEN p_partkey % 3 = 0 THEN '1.0' WHEN p_partkey % 3 = 1 THEN '2.0' ELSE '3.0' END AS model_type,
  CAST(p_partkey AS STRING) AS item_code, p_name AS item_vn_name, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS item_en_name,
  CAST(p_partkey AS INTEGER) AS display_order, CAST(p_partkey % 3 AS INTEGER) AS display_level
FROM part WHERE p_partkey < 60
""",
    "financial_statements": """
SELECT CONCAT('T', CAST(l_suppkey AS STRING)) AS code, CAST(l_partkey % 60 AS STRING) AS item_code, 'ANNUAL' AS report_type,
  CASE WHEN l_partkey % 60 % 3 = 0 THEN '1.0' WHEN l_partkey % 60 % 3 = 1 THEN '2.0' ELSE '3.0' END AS model_type,
  MAX(l_extendedprice) * 1000000 AS numeric_value, CONCAT(CAST(year(l_shipdate) AS STRING), '-12-31') AS fiscal_date
FROM lineitem GROUP BY l_suppkey, l_partkey % 60, year(l_shipdate)
""",
    "inference_results_hyde2": """
SELECT CONCAT('T', CAST(o_custkey % 50 AS STRING)) AS ticker, CAST(year(o_orderdate) AS INTEGER) AS year,
  CONCAT(CASE o_orderkey % 9 WHEN 0 THEN 'CC1' WHEN 1 THEN 'GHG1' WHEN 2 THEN 'GHG2' WHEN 3 THEN 'GHG3' WHEN 4 THEN 'GHG4' WHEN 5 THEN 'GHG7' WHEN 6 THEN 'EC1' WHEN 7 THEN 'RC1' ELSE 'ACC1' END,
         CASE o_orderkey % 4 WHEN 0 THEN '_alt' WHEN 1 THEN '_alt_two' ELSE '' END) AS category_code,
  MAX(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) = 1 AS is_valid, MIN(o_orderpriority) AS reason,
  'gpt-4.1-mini' AS model, MAX(o_orderdate) AS created_at
FROM orders GROUP BY 1, 2, 3
""",
    "proper_vn_results_hyde2": """
SELECT CONCAT('T', CAST(o_custkey % 50 AS STRING)) AS ticker, CAST(year(o_orderdate) AS INTEGER) AS year,
  CASE o_orderkey % 7 WHEN 0 THEN 'S1_VIOLATION' WHEN 1 THEN 'S1_MINOR_NC' WHEN 2 THEN 'S1_COMPLIANCE' WHEN 3 THEN 'S2_ISO14001' WHEN 4 THEN 'S2_CARBON_DISC' WHEN 5 THEN 'S2_REDUCTION' ELSE 'S2_EFFICIENCY' END AS indicator_code,
  MAX(o_orderkey % 13) > 8 AS is_present,
  CASE WHEN MAX(o_orderkey % 13) > 11 THEN 'quantified' WHEN MAX(o_orderkey % 13) > 8 THEN 'basic_mention' ELSE 'none' END AS evidence_level,
  MIN(o_orderpriority) AS reason, 'gpt-4.1-mini' AS model, MAX(o_orderdate) AS created_at
FROM orders GROUP BY 1, 2, 3
""",
    "governance_results_hyde2": """
SELECT CONCAT('T', CAST(o_custkey % 50 AS STRING)) AS ticker, CAST(year(o_orderdate) AS INTEGER) AS year,
  CASE o_orderkey % 4 WHEN 0 THEN 'GOV_DIRECTORY' WHEN 1 THEN 'GOV_EXECUTIVE' WHEN 2 THEN 'GOV_SUPERVISORY' ELSE 'GOV_SHAREHOLDERS' END AS item_code,
  COUNT(*) > 1 AS found,
  CONCAT('{"total_members": ', CAST(COUNT(*) AS STRING), '}') AS value_json,
  CASE WHEN COUNT(*) = 1 THEN NULL ELSE CONCAT('[{"name": "', MIN(o_orderpriority), '", "gender": "', CASE WHEN MIN(o_orderkey) % 2 = 0 THEN ' Female' ELSE 'male' END, '", "is_independent": ', CASE WHEN MIN(o_orderkey) % 3 = 0 THEN 'true' ELSE 'false' END, '}',
    CASE WHEN COUNT(*) > 3 THEN CONCAT(', {"name": "', MAX(o_orderpriority), '", "gender": "nữ", "is_independent": null}') ELSE '' END, ']') END AS details_json,
  'gpt-4.1-mini' AS model, MAX(o_orderdate) AS created_at
FROM orders GROUP BY 1, 2, 3
""",
    "financial_statement_audit_results": """
SELECT CONCAT('T', CAST(o_custkey % 50 AS STRING)) AS ticker, CAST(year(o_orderdate) AS INTEGER) AS year, TRUE AS found,
  CASE MIN(o_orderkey) % 5 WHEN 0 THEN 'Deloitte Việt Nam' WHEN 1 THEN 'Ernst & Young' WHEN 2 THEN 'PwC' WHEN 3 THEN 'KPMG' ELSE 'AASC' END AS audit_firm,
  CASE MIN(o_orderkey) % 5 WHEN 4 THEN '{"external_audit_firm_en": "AASC"}' ELSE '{"external_audit_firm": "Big4"}' END AS value_json,
  'gpt-4.1-mini' AS model
FROM orders GROUP BY 1, 2
""",
    "company_history_summary": """
SELECT CONCAT('T', CAST(c_custkey AS STRING)) AS ticker, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(1950 + c_custkey % 60 AS INTEGER) END AS first_event_year FROM customer
""",
    "inference_jobs": """
SELECT CONCAT('T', CAST(o_custkey % 50 AS STRING)) AS ticker, CAST(year(o_orderdate) AS INTEGER) AS year, 'gpt-4.1-mini' AS model,
  CASE MIN(o_orderkey) % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'completed' END AS status
FROM orders GROUP BY 1, 2
""",
    "llm_request_inputs": """
SELECT event_id AS id, event_type AS task_type, CONCAT('T', CAST(user_id AS STRING)) AS ticker, CAST(year(ts) AS INTEGER) AS year, props AS request_body, value AS score, ts AS created_at FROM events
""",
    "financial_statement_reports": """
SELECT CONCAT('T', CAST(doc_id % 2003 AS STRING)) AS ticker, CAST(1995 + doc_id % 5 AS INTEGER) AS year, text AS content
FROM documents WHERE doc_id % 3 = 0
""",
    "proper_vn_jobs": """
SELECT CONCAT('T', CAST(o_custkey % 50 AS STRING)) AS ticker, CAST(year(o_orderdate) AS INTEGER) AS year, 'gpt-4.1-mini' AS model,
  CASE MIN(o_orderkey) % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'completed' END AS status
FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2
""",
    "governance_jobs": """
SELECT CONCAT('T', CAST(o_custkey % 50 AS STRING)) AS ticker, CAST(year(o_orderdate) AS INTEGER) AS year, 'gpt-4.1-mini' AS model,
  CASE MAX(o_orderkey) % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' ELSE 'completed' END AS status
FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2
""",
    "financial_statement_document_embeddings": """
SELECT CONCAT('T', CAST(e.label AS STRING)) AS ticker, CAST(1995 + e.vec_id % 3 AS INTEGER) AS year,
  CAST(ROW_NUMBER() OVER (PARTITION BY e.label, e.vec_id % 3 ORDER BY e.vec_id) - 1 AS INTEGER) AS chunk_index,
  d.text AS chunk_text, CAST(16 + e.vec_id % 97 AS INTEGER) AS token_count, e.embedding AS embedding, 'text-embedding-3-small' AS model
FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id % (SELECT COUNT(*) FROM documents) WHERE e.label % 2 = 0
""",
    "inference_results": """
SELECT CONCAT('T', CAST(o_custkey % 60 AS STRING)) AS ticker, CAST(year(o_orderdate) AS INTEGER) AS year,
  CASE o_orderkey % 4 WHEN 0 THEN 'CC1' WHEN 1 THEN 'GHG1' WHEN 2 THEN 'EC1' ELSE 'RC1' END AS category_code,
  MAX(o_orderkey % 7) > 3 AS is_valid, 'gpt-4.1-mini' AS model
FROM orders GROUP BY 1, 2, 3
""",
    "company_history_events": """
SELECT CONCAT('T', CAST(user_id AS STRING)) AS ticker, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS event_order,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(1950 + event_id % 60 AS INTEGER) END AS event_year, event_type AS event_text
FROM events
""",
    "pipeline_files": """
SELECT CONCAT('T', CAST(o_custkey AS STRING)) AS ticker, CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN o_orderkey % 2 = 0 THEN 'raw' ELSE 'markdown' END AS stage,
  CONCAT('files/', CAST(MIN(o_orderkey) AS STRING)) AS file_path
FROM orders GROUP BY 1, 2, 3
""",
    "proper_vn_results": """
SELECT CONCAT('T', CAST(o_custkey % 60 AS STRING)) AS ticker, CAST(year(o_orderdate) AS INTEGER) AS year,
  CASE o_orderkey % 3 WHEN 0 THEN 'S1_VIOLATION' WHEN 1 THEN 'S2_ISO14001' ELSE 'S2_EFFICIENCY' END AS indicator_code,
  MAX(o_orderkey % 13) > 8 AS is_present, 'gpt-4.1-mini' AS model
FROM orders GROUP BY 1, 2, 3
""",
    "governance_results": """
SELECT CONCAT('T', CAST(o_custkey % 60 AS STRING)) AS ticker, CAST(year(o_orderdate) AS INTEGER) AS year,
  CASE o_orderkey % 4 WHEN 0 THEN 'GOV_DIRECTORY' WHEN 1 THEN 'GOV_EXECUTIVE' WHEN 2 THEN 'GOV_SUPERVISORY' ELSE 'GOV_SHAREHOLDERS' END AS item_code,
  COUNT(*) > 1 AS found, 'gpt-4.1-mini' AS model
FROM orders GROUP BY 1, 2, 3
""",
    "chunk_items": """
SELECT CONCAT('run', CAST(user_id % 7 AS STRING)) AS run_id, CONCAT('T', CAST(user_id AS STRING)) AS ticker, CAST(1995 + event_id % 3 AS INTEGER) AS year,
  CAST(event_id AS INTEGER) AS chunk_index, CAST(event_id % 8 AS INTEGER) AS attempt_count,
  CASE WHEN event_id % 97 = 0 THEN 'failed' WHEN event_id % 11 = 0 THEN 'pending' ELSE 'completed' END AS status
FROM events
""",
    "stored_chunks": """
SELECT CONCAT('T', CAST(label AS STRING)) AS ticker, CAST(1995 + vec_id % 3 AS INTEGER) AS year,
  CAST(ROW_NUMBER() OVER (PARTITION BY label, vec_id % 3 ORDER BY vec_id) - 1 AS INTEGER) AS chunk_index, vec_id,
  CASE vec_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN '{"metadata_source": "hybrid"}' ELSE '{"schema_version": 1}' END AS chunk_metadata_json
FROM embeddings
""",
    "run_items": """
SELECT CONCAT('run', CAST(label % 3 AS STRING)) AS run_id, CONCAT('batch', CAST(vec_id % 5 AS STRING)) AS batch_id, CONCAT('c', CAST(vec_id AS STRING)) AS custom_id,
  CONCAT('T', CAST(label AS STRING)) AS ticker, CAST(1995 + vec_id % 3 AS INTEGER) AS year,
  CAST(ROW_NUMBER() OVER (PARTITION BY label, vec_id % 3 ORDER BY vec_id) - 1 AS INTEGER) AS chunk_index,
  CASE WHEN vec_id % 7 = 0 THEN 'pending' WHEN vec_id % 7 = 1 THEN 'failed' WHEN vec_id % 7 = 2 THEN 'completed' ELSE 'submitted' END AS status
FROM embeddings WHERE label % 2 = 0
""",
    "run_batches": """
SELECT DISTINCT CONCAT('batch', CAST(vec_id % 5 AS STRING)) AS batch_id,
  CASE vec_id % 5 WHEN 0 THEN 'expired' WHEN 1 THEN 'in_progress' ELSE 'completed' END AS batch_status
FROM embeddings
""",
    "run_answers": """
SELECT CONCAT('c', CAST(vec_id AS STRING)) AS custom_id,
  CASE WHEN vec_id % 11 = 0 THEN 'sorry' ELSE CONCAT('{"n":', CAST(vec_id AS STRING), '}') END AS answer
FROM embeddings WHERE vec_id % 13 <> 0
""",
    "model_presets": """
SELECT CASE WHEN p_partkey % 2 = 0 THEN 'embedding' ELSE 'inference' END AS task_type, CONCAT('model-', CAST(p_partkey AS STRING)) AS model_name,
  p_partkey % 5 <> 0 AS is_active, CAST(NULL AS TIMESTAMP) AS created_at
FROM part WHERE p_partkey <= 40
""",
}


class Views:
    """The relations of one folder as lazy DataFrames: ``views.stocks``, ``views.orders`` and so on."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            path = f"{self.sf_dir}/{name}.parquet"
            return read_table(self.spark, path) if name == "documents" else self.spark.read.parquet(path)  # texts are costly, facts are not
        if name not in VIEWS:
            raise AttributeError(name)
        for table in tables_of(VIEWS[name]):
            getattr(self, table).createOrReplaceTempView(table)
        return self.spark.sql(VIEWS[name])


def tables_of(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b{t}\b", sql)]


def with_views(sql: str) -> str:
    """DuckDB SQL with the relations that it names as leading common table expressions."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    heads = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in used)
    if not heads:
        return sql
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {heads},\n{body[15:].lstrip()}"
    return f"WITH {heads},\n{body[4:].lstrip()}" if body[:5].upper() == "WITH " else f"WITH {heads}\n{body}"
