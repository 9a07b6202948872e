"""Queries of single rules that other queries only use in part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import text as X
from ..operators import dashboards as G
from ..operators import documents as D
from ..operators import pivots as P
from ..operators import runs as M
from ..operators import scoring as S
from ..operators import state as U
from ..operators.rosters import refined
from .registry import query
from .texts import _BLOCKED, _SCORE, _TITLE, TAGGED, _sql, _tagged

_JOBS = ["inference_jobs", "proper_vn_jobs", "governance_jobs"]


@query("job_model_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, model, status, COUNT(*) AS jobs FROM {t} GROUP BY model, status" for t in _JOBS))
def _(v):
    """Jobs by model and status in each job table."""
    parts = [getattr(v, t).groupBy("model", "status").agg(F.count("*").alias("jobs")).select(F.lit(t).alias("table_name"), "model", "status", "jobs") for t in _JOBS]
    return reduce(DataFrame.unionByName, parts)


_ORDERED = ", ".join(f"'{c}'" for c in P.EDC_CODES)


@query(
    "checklist_groups",
    f"""SELECT ticker, year, model, CASE {' '.join(f"WHEN category_code IN ({', '.join(repr(c) for c in codes)}) THEN '{g}'" for g, codes in P.EDC_GROUPS.items())} END AS item_group,
  string_agg(category_code || '=' || is_valid, ',' ORDER BY list_position([{_ORDERED}], category_code)) AS items FROM inference_results_hyde2 WHERE category_code IN ({_ORDERED}) GROUP BY ALL""",
)
def _(v):
    """The items of each firm-year by checklist group, in the checklist's order."""
    return P.grouped_items(v.inference_results_hyde2)


@query("top_tickers", "SELECT ticker, COUNT(*) FILTER (is_valid) AS valid, COUNT(*) AS total, ROUND(100.0 * COUNT(*) FILTER (is_valid) / COUNT(*), 1) AS valid_pct FROM inference_results_hyde2 GROUP BY ticker ORDER BY total DESC, ticker LIMIT 20")
def _(v):
    return P.top_tickers(v.inference_results_hyde2)


@query("history_year", r"SELECT doc_id, TRY_CAST(regexp_extract(text, '(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)', 1) AS INTEGER) AS year FROM documents")
def _(v):
    """The first year that stands alone in whole texts."""
    return v.documents.select("doc_id", X.history_year(F.col("text")).alias("year"))


@query(
    "prompt_text",
    """WITH s AS (SELECT *, SUM(token_count) OVER w AS upto, ROW_NUMBER() OVER w AS place FROM document_embeddings WINDOW w AS (PARTITION BY ticker, year ORDER BY chunk_index))
SELECT ticker, year, string_agg('[chunk_index=' || CASE WHEN chunk_index = 0 THEN -1 ELSE chunk_index END || ']' || chr(10) || chunk_text, chr(10) || chr(10) ORDER BY place) AS prompt FROM s WHERE place = 1 OR upto <= 300 GROUP BY ticker, year""",
)
def _(v):
    """Prompts of chunks within a budget of tokens, each under its index."""
    return D.prompt_text(D.within_budget(v.document_embeddings, ["ticker", "year"], budget=300), ["ticker", "year"])


_SCORED = "SELECT ticker, year, CASE COUNT(*) % 3 WHEN 0 THEN 'fail' WHEN 1 THEN 'warning' ELSE 'pass' END AS quality_status, CASE WHEN COUNT(*) % 2 = 0 THEN 'garbled' ELSE '' END AS quality_reason, CAST(MAX(chunk_index) AS INTEGER) AS garbled_count FROM chunk_items GROUP BY ticker, year"


@query(
    "queued_reruns",
    f"""WITH s AS ({_SCORED}), j AS (SELECT ticker, year, status, force_ocr, 'old' AS rerun_reason FROM conversion_jobs)
SELECT 'status' AS rule, j.ticker, j.year, CASE WHEN s.ticker IS NOT NULL THEN 'pending' ELSE status END AS status, force_ocr OR s.ticker IS NOT NULL AS force_ocr, CASE WHEN s.ticker IS NOT NULL THEN coalesce(nullif(quality_reason, ''), rerun_reason) ELSE rerun_reason END AS rerun_reason
FROM j LEFT JOIN (SELECT * FROM s WHERE quality_status = 'fail') s USING (ticker, year)
UNION ALL SELECT 'garbled', j.ticker, j.year, CASE WHEN s.ticker IS NOT NULL THEN 'pending' ELSE status END, force_ocr OR s.ticker IS NOT NULL, CASE WHEN s.ticker IS NOT NULL THEN coalesce(nullif(quality_reason, ''), rerun_reason) ELSE rerun_reason END
FROM j LEFT JOIN (SELECT * FROM s WHERE garbled_count >= 500) s USING (ticker, year)""",
)
def _(v):
    """Jobs of bad reports pending again with forced recognition: those that failed, or with 500 garbled words."""
    n = F.count("*")
    scored = v.chunk_items.groupBy("ticker", "year").agg(
        F.when(n % 3 == 0, "fail").when(n % 3 == 1, "warning").otherwise("pass").alias("quality_status"), F.when(n % 2 == 0, "garbled").otherwise("").alias("quality_reason"), F.max("chunk_index").alias("garbled_count")
    )
    jobs = v.conversion_jobs.select("ticker", "year", "status", "force_ocr", F.lit("old").alias("rerun_reason"))
    parts = [U.queue_reruns(jobs, scored, least).withColumn("rule", F.lit(rule)) for rule, least in (("status", None), ("garbled", 500))]
    return parts[0].unionByName(parts[1])


@query(
    "statement_source",
    f"""WITH t AS (SELECT ticker, CAST(id % 3 AS INTEGER) AS slot, id, {_TITLE} || '.pdf' AS name, {_TITLE} AS title FROM listed_documents), n AS (SELECT *, replace(strip_accents(lower(trim(title))), 'đ', 'd') AS t FROM t),
s AS (SELECT *, (t LIKE '%bao cao tai chinh%' OR t LIKE '%bctc%') AND t LIKE '%kiem toan%' AND NOT ({_BLOCKED}) AS preferred, {_SCORE} AS score, id % 1000 AS size, 'raw/' || id || '/' || name AS path FROM n)
SELECT ticker, slot, path FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker, slot ORDER BY preferred DESC, score DESC, size DESC, name DESC, id DESC) = 1""",
)
def _(v):
    """The best of each firm's statement files: preferred title, title's points, size, name."""
    title = F.expr(_TITLE)
    name = F.concat(title, F.lit(".pdf"))
    files = v.listed_documents.select("ticker", F.expr("cast(id % 3 as int)").alias("slot"), name.alias("name"), F.expr("id % 1000").alias("size"), F.concat(F.lit("raw/"), F.col("id").cast("string"), F.lit("/"), name).alias("path"), "id")
    return D.statement_source(files, ["ticker", "slot"], ["id"])


#: One answer for each firm-year and item; ``k`` tells its values, so SQL knows what follows from them.
_GOVERNED = """SELECT CONCAT('T', CAST(c AS STRING)) AS ticker, y AS year, 'm' AS model, k, i, CASE i WHEN 0 THEN 'GOV_SHAREHOLDERS' WHEN 1 THEN 'GOV_DIRECTORY' WHEN 2 THEN 'GOV_EXECUTIVE' WHEN 3 THEN 'GOV_AUDIT' ELSE 'GOV_SUPERVISORY' END AS item_code,
  CASE i WHEN 0 THEN CONCAT('{"total_outstanding_shares": ', CAST(k AS STRING), '.5, "total_treasury_shares": ', CAST(k % 7 AS STRING), ', "foreign_ownership_pct": ', CAST(k % 100 AS STRING), ', "state_ownership_pct": null, "institutional_shares": 3, "individual_shares": ', CAST(k % 9 AS STRING), '}')
    WHEN 1 THEN CONCAT('{"total_members": ', CAST(k % 3 AS STRING), CASE WHEN k % 2 = 0 THEN CONCAT(', "women_count": ', CAST(k % 4 AS STRING)) ELSE '' END, ', "men_count": ', CAST(k % 5 AS STRING), ', "foreign_count": 1', CASE WHEN k % 4 = 0 THEN ', "independent_count": 2' ELSE '' END,
      ', "chair_name": "', CASE k % 3 WHEN 0 THEN 'Ông A' WHEN 1 THEN ' ông a ' ELSE '' END, '"}')
    WHEN 2 THEN CONCAT('{', CASE WHEN k % 2 = 0 THEN '"total_members": 4, ' ELSE '' END, '"ceo_name": "', CASE WHEN k % 2 = 0 THEN 'ÔNG A' ELSE 'B' END, '", "chief_accountant_name": "C"', CASE WHEN k % 3 = 0 THEN ', "board_member_count": 1' ELSE '' END, '}')
    WHEN 3 THEN CONCAT('{"external_audit_firm": "', CASE WHEN k % 3 = 0 THEN 'X' ELSE '' END, '", "external_audit_firm_en": "', CASE WHEN k % 3 = 1 THEN 'Y' ELSE '' END, '", "audit_firm": "Z", "audit_opinion": "unqualified", "has_internal_audit_committee": ', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END,
      ', "internal_audit_committee_size": ', CAST(k % 6 AS STRING), '}')
    ELSE CONCAT('{"total_members": ', CAST(k % 2 AS STRING), ', "women_count": ', CAST(k % 3 AS STRING), ', "independent_count": null}') END AS value_json,
  CASE k % 4 WHEN 0 THEN '[]' WHEN 1 THEN '[{"name": "A", "gender": "female", "is_independent": true, "is_board_member": "0"}]' WHEN 2 THEN '[{"name": "A", "gender": "female", "is_independent": true, "is_board_member": "0"}, {"name": "B", "gender": "Male", "is_independent": "false", "is_board_member": true}]'
    ELSE '[{"name": "A", "gender": "female", "is_independent": true, "is_board_member": "0"}, {"name": "B", "gender": "Male", "is_independent": "false", "is_board_member": true}, {"name": "C", "gender": "FEMALE", "is_independent": 1, "is_board_member": "yes"}]' END AS details_json
FROM (SELECT o_custkey % 50 AS c, CAST(year(o_orderdate) AS INTEGER) AS y, o_orderkey % 5 AS i, MIN(o_orderkey) AS k FROM orders GROUP BY 1, 2, 3) o"""


def _told(k: str, zero: str, one: int, two: int, three: int) -> str:
    return f"CASE {k} % 4 WHEN 0 THEN {zero} WHEN 1 THEN {one} WHEN 2 THEN {two} WHEN 3 THEN {three} END"


@query(
    "governance_columns",
    f"""WITH g AS ({_GOVERNED}), p AS (SELECT ticker, year, model, {', '.join(f'MAX(k) FILTER (i = {i}) AS {n}' for i, n in enumerate(('sh', 'bd', 'ex', 'au', 'sv')))} FROM g GROUP BY ALL),
c AS (SELECT *, CASE bd % 3 WHEN 0 THEN 'Ông A' WHEN 1 THEN ' ông a ' WHEN 2 THEN '' END AS chair, CASE ex % 2 WHEN 0 THEN 'ÔNG A' WHEN 1 THEN 'B' END AS ceo FROM p)
SELECT ticker, year, model, sh + 0.5::DOUBLE AS total_outstanding_shares, (sh % 7)::DOUBLE AS total_treasury_shares, (sh % 100)::DOUBLE AS foreign_ownership_pct, NULL::DOUBLE AS state_ownership_pct, CASE WHEN sh IS NOT NULL THEN 3.0::DOUBLE END AS institutional_shares, (sh % 9)::DOUBLE AS individual_shares,
  NULLIF(sh % 4, 0)::INTEGER AS shareholder_count, COALESCE(NULLIF(bd % 3, 0), NULLIF(bd % 4, 0), bd % 3)::INTEGER AS total_board_members, (CASE WHEN bd % 2 = 0 THEN bd % 4 ELSE {_told('bd', 'NULL', 1, 1, 2)} END)::INTEGER AS women_board_members, (bd % 5)::INTEGER AS men_board_members,
  CASE WHEN bd IS NOT NULL THEN 1 END AS foreign_board_members, {_told('bd', '2', 1, 1, 2)} AS independent_board_members, chair AS chair_name, ceo AS ceo_name, CASE WHEN ex IS NOT NULL THEN 'C' END AS chief_accountant_name,
  (CASE WHEN ex % 2 = 0 THEN 4 ELSE ex % 4 END)::INTEGER AS executive_member_count, CASE WHEN ex % 3 = 0 THEN 1 ELSE {_told('ex', 'NULL', 0, 1, 2)} END AS executive_board_overlap_count, CASE WHEN chair <> '' THEN lower(trim(chair)) = lower(trim(ceo)) END AS chair_is_ceo,
  CASE au % 3 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' WHEN 2 THEN 'Z' END AS audit_firm, CASE WHEN au IS NOT NULL THEN 'unqualified' END AS audit_opinion, au % 2 = 0 AS has_internal_audit_committee, (au % 6)::INTEGER AS internal_audit_committee_size,
  COALESCE(NULLIF(sv % 2, 0), NULLIF(sv % 4, 0), sv % 2)::INTEGER AS total_supervisory_members, (sv % 3)::INTEGER AS supervisory_women_count, NULL::INTEGER AS supervisory_independent_count FROM c""",
)
def _(v):
    """All derived variables of each firm-year, values first, then what the rosters count."""
    v.orders.createOrReplaceTempView("orders")
    return S.governance_variables(v.spark.sql(_GOVERNED).drop("k", "i"))


_ROSTERED = """SELECT CONCAT('T', CAST(o_orderkey AS STRING)) AS ticker, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'GOV_EXECUTIVE' ELSE 'GOV_AUDIT' END AS item_code,
  CASE WHEN o_orderkey % 2 = 0 THEN CONCAT('[{"name": "Lê Văn An", "position": "Tổng Giám đốc", "gender": "male"}, {"name": "Trần Thị Bé", "position": "Kế toán trưởng", "gender": "female"}', CASE WHEN o_orderkey % 3 = 0 THEN ', {"name": "Hồ Văn Chi", "position": "Phó Tổng Giám đốc kiêm Thành viên HĐQT", "gender": "male"}' ELSE '' END, ']')
    ELSE CONCAT('[{"name": " Đỗ Văn Em ", "role": "Signing auditor"}', CASE WHEN o_orderkey % 3 = 0 THEN ', {"name": "", "role": "signing partner"}, {"name": "Vũ Thị Gấm", "role": "reviewer"}' ELSE '' END, ']') END AS details_json FROM orders"""


@query(
    "roster_roles",
    f"""WITH r AS ({_ROSTERED}) SELECT ticker, year, item_code, CASE WHEN k % 2 = 0 THEN 'Lê Văn An' END AS ceo_name, CASE WHEN k % 2 = 0 THEN 'Trần Thị Bé' END AS chief_accountant_name,
  CAST(CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS INTEGER) AS board_member_count, CASE WHEN k % 2 = 1 THEN 'Đỗ Văn Em' END AS signing FROM r""",
)
def _(v):
    """Executives and signing auditors that rosters name."""
    v.orders.createOrReplaceTempView("orders")
    return refined(v.spark.sql(_ROSTERED)).select("ticker", "year", "item_code", "ceo_name", "chief_accountant_name", "board_member_count", F.array_join("signing_auditor_names", ",").alias("signing"))


@query(
    "money_text",
    """SELECT code, item_code, fiscal_date, CASE WHEN numeric_value IS NULL OR numeric_value = 0 THEN '' WHEN abs(numeric_value / 1e9) < 1 THEN format('{:,.1f}', numeric_value / 1e9) ELSE format('{:,.0f}', numeric_value / 1e9) END AS amount,
  CASE WHEN abs(numeric_value / 1e8) >= 1000 THEN format('{:,.0f}', numeric_value / 1e8) WHEN abs(numeric_value / 1e8) >= 1 THEN format('{:,.2f}', numeric_value / 1e8) ELSE format('{:,.4f}', numeric_value / 1e8) END AS ratio FROM financial_statements""",
)
def _(v):
    """Amounts in billions and ratios as a report shows them."""
    return v.financial_statements.select("code", "item_code", "fiscal_date", X.billions(F.col("numeric_value")).alias("amount"), X.ratio_text(F.col("numeric_value") / 1e8).alias("ratio"))


@query("renamed_folders", "SELECT id, replace(CASE WHEN id % 2 = 0 THEN 'data/markdown_bctc/' ELSE 'data/markdown/' END || id || '.md', 'markdown_bctc/', 'markdown_financial_statement/') AS source_file FROM listed_documents")
def _(v):
    path = F.concat(F.when(F.col("id") % 2 == 0, "data/markdown_bctc/").otherwise("data/markdown/"), F.col("id").cast("string"), F.lit(".md"))
    return v.listed_documents.select("id", X.renamed_folder(path).alias("source_file"))


@query("chosen_results", "SELECT ticker, COUNT(*) AS n FROM inference_results GROUP BY ticker")
def _(v):
    """Results of the first table that has any: the newer one is empty here."""
    return G.first_filled(v.inference_results_hyde2.where("year < 1900").select("ticker"), v.inference_results.select("ticker")).groupBy("ticker").agg(F.count("*").alias("n"))


@query(
    "metadata_branch",
    f"""WITH {_sql(TAGGED)} SELECT 'stored' AS branch, vec_id AS id, chunk_metadata_json AS told FROM stored_chunks
UNION ALL SELECT 'made', doc_id, CASE WHEN contains(chunk_text, '|') THEN 'true' ELSE 'false' END FROM tagged""",
)
def _(v):
    """Stored metadata where a table has the column, else what the texts say: the plan follows the table's columns."""
    stored = M.with_metadata(v.stored_chunks).select(F.lit("stored").alias("branch"), F.col("vec_id").alias("id"), F.col("chunk_metadata_json").alias("told"))
    made = M.with_metadata(_tagged(v)).select(F.lit("made").alias("branch"), F.col("doc_id").alias("id"), F.get_json_object("chunk_metadata_json", "$.signals.has_table_like").alias("told"))
    return stored.unionByName(made)


@query("first_words", r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')[1:50], ' ') AS kept FROM documents")
def _(v):
    """Texts cut to a limit of words, as for a model without a vocabulary at hand."""
    return v.documents.select("doc_id", X.first_words(F.col("text"), 50).alias("kept"))


@query(
    "signers",
    """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Ông A|Bà ' || c_name WHEN 1 THEN c_name WHEN 2 THEN '' ELSE '[broken' END AS names FROM customer""",
)
def _(v):
    """Stored signers: a JSON list of names, or a text that is the only one."""
    raw = F.expr("""CASE c_custkey % 4 WHEN 0 THEN CONCAT('["Ông A", "Bà ', c_name, '"]') WHEN 1 THEN c_name WHEN 2 THEN NULL ELSE '[broken' END""")
    return v.customer.select(F.col("c_custkey").alias("id"), F.array_join(J.list_or_text(raw), "|").alias("names"))


_STATED = """CONCAT(CASE doc_id % 5 WHEN 0 THEN 'Bảng Cân Đối kế toán. Báo cáo LƯU CHUYỂN TIỀN TỆ. ' WHEN 1 THEN 'Kính gửi: Ủy ban chứng khoán. Nghị quyết ' ELSE '' END, text)"""
_PLAIN_STATED = "replace(strip_accents(lower(trim(t))), 'đ', 'd')"
_IN = lambda markers: " + ".join(f"CAST(contains(p, '{m}') AS INTEGER)" for m in markers)


@query(
    "content_markers",
    f"""WITH s AS (SELECT doc_id, {_STATED} AS t FROM documents), p AS (SELECT doc_id, {_PLAIN_STATED} AS p, len(regexp_extract_all(t, '[0-9A-Za-zÀ-ỹĐđ]+')) AS n FROM s),
c AS (SELECT doc_id, CAST(n AS INTEGER) AS token_count, {_IN(D.SECTION_MARKERS)} AS section_count, {_IN(D.DISCLOSURE_MARKERS)} AS disclosure_count FROM p)
SELECT *, section_count = 0 AND (token_count < 3000 OR disclosure_count > 0) AS other FROM c""",
)
def _(v):
    """Sections and letters' markers in whole statements, and which of them are none."""
    v.documents.createOrReplaceTempView("documents")
    rows = v.spark.sql(f"SELECT doc_id, {_STATED} AS content FROM documents")
    out = D.content_checks(D.quality(rows))
    return out.select("doc_id", "token_count", "section_count", "disclosure_count", F.coalesce(F.array_contains(F.split("quality_reason", ","), D.NOT_A_STATEMENT), F.lit(False)).alias("other"))
