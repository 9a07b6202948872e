"""Queries of flows between the store and the outside: request batches, cached query vectors, paged listings."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answers as N
from ..operators import audits as A
from ..operators import batching as B
from ..operators import cascades as C
from ..operators import documents as D
from ..operators import query_cache as Q
from ..schema import evolved
from ..session import ensure_checkpoints
from ..sources import listing as L
from ..sources.files import Store
from .registry import query

#: What a batch begins with, row by row; {k}, {budget} and {size} are filled in.  ``t``: (keys, pos, tokens).
_RECURSION = """s AS (SELECT *, SUM(tokens) OVER (PARTITION BY {k} ORDER BY pos) AS upto FROM t),
n AS (SELECT a.{k}, a.pos, MIN(b.pos) AS next FROM s a LEFT JOIN s b ON a.{k} = b.{k} AND b.pos > a.pos AND b.pos <= a.pos + {size} AND (b.pos = a.pos + {size} OR b.upto - a.upto + a.tokens > {budget}) GROUP BY 1, 2),
r AS (SELECT {k}, CAST(1 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS batch FROM t WHERE pos = 1 UNION ALL SELECT r.{k}, n.next, r.batch + 1 FROM r JOIN n ON r.{k} = n.{k} AND r.pos = n.pos WHERE n.next IS NOT NULL)"""


@query(
    "embed_batches",
    f"""WITH RECURSIVE w AS (SELECT ticker, year, source_file, list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '') AS w FROM annual_reports),
c AS (SELECT *, unnest(list_filter(range(0, len(w), 384), lambda x: x = 0 OR x - 384 + 512 < len(w))) AS s FROM w),
t AS (SELECT 0 AS k, ticker, year, source_file, CAST(s // 384 AS INTEGER) AS chunk_index, CAST(least(8000, greatest(1, length(array_to_string(w[s + 1:s + 512], ' ')) // 4)) AS INTEGER) AS tokens,
  row_number() OVER (ORDER BY ticker, year, source_file, s) AS pos FROM c),
{_RECURSION.format(k='k', budget=B.MOST_TOKENS, size=B.MOST_TEXTS)}
SELECT ticker, year, source_file, chunk_index, tokens, r.batch FROM t ASOF JOIN r ON t.k = r.k AND t.pos >= r.pos""",
)
def _(v):
    """The embedding requests of all report chunks, in order: one sequence."""
    tokens = F.least(F.lit(B.MOST_TEXT_TOKENS), X.estimated_tokens(F.col("chunk_text"))).alias("tokens")
    inputs = D.chunks(v.annual_reports).select("ticker", "year", "source_file", "chunk_index", tokens)
    return B.token_batches(inputs, [], ["ticker", "year", "source_file", "chunk_index"], F.col("tokens"))


@query(
    "source_batches",
    f"""WITH RECURSIVE t AS (SELECT source, doc_id, greatest(1, length(text) // 4) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents),
{_RECURSION.format(k='source', budget=24_000, size=64)}
SELECT t.source, batch, CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(SUM(tokens) AS BIGINT) AS n_tokens FROM t ASOF JOIN r ON t.source = r.source AND t.pos >= r.pos GROUP BY ALL""",
)
def _(v):
    """Prompts of whole documents, source by source; one source holds a third of them."""
    rows = v.documents.select("source", "doc_id", X.estimated_tokens(F.col("text")).alias("tokens"))
    return B.batch_sizes(B.token_batches(rows, ["source"], ["doc_id"], F.col("tokens"), 24_000, 64), ["source"], F.col("tokens"))


def counted(texts: list[str], model: str, dimensions: int) -> list[list[float]]:
    """A provider for offline runs whose vectors SQL can tell: how often each of some letters occurs."""
    return [[float(t.lower().count(c)) for c in "aeiounst"[:dimensions]] for t in texts]


def doubled(criteria: list[str], model: str, n: int) -> list[list[str]]:
    """Hypotheses of a criterion; it refuses those of a length that seven divides."""
    if any(len(c) % 7 == 0 for c in criteria):
        raise ValueError("no hypotheses for a criterion of this length")
    return [[f"{c} {c}", f" {model} "][:n] for c in criteria]


_COUNT = "[{}]".format(", ".join(f"CAST(length(x) - length(replace(x, '{c}', '')) AS DOUBLE)" for c in "aeiounst"))
_CRITERIA = r"SELECT regexp_replace(text, '^\s+|\s+$', '', 'g') AS criterion, item_id FROM benchmark"


@query(
    "cached_query_vectors",
    f"""WITH c AS ({_CRITERIA}), q AS (SELECT criterion, bool_or(item_id % 3 = 0) AS earlier FROM c WHERE criterion <> '' GROUP BY 1),
x AS (SELECT *, list_transform([lower(criterion), lower(criterion || ' ' || criterion), 'small-1'], lambda x: {_COUNT}) AS v FROM q)
SELECT criterion, CASE WHEN length(criterion) % 7 = 0 THEN 'plain' WHEN earlier THEN 'cache' ELSE 'new' END AS origin,
  array_to_string(list_transform(range(1, 9), lambda i: CAST(CAST(round(CASE WHEN length(criterion) % 7 = 0 THEN v[1][i] ELSE 10000 * (v[1][i] + v[2][i] + v[3][i]) / 3 END) AS BIGINT) AS VARCHAR)), ',') AS vector FROM x""",
)
def _(v):
    """Vectors of the benchmark's texts by a second run; the first one knew every third item."""
    store = Store(v.spark, f"{ensure_checkpoints(v.spark)}/store-{uuid.uuid4().hex}")
    ask = lambda rows: Q.cached_vectors(store, Q.requests(rows, "text", "letters", 8, "small-1"), doubled, counted)
    ask(v.benchmark.where("item_id % 3 = 0"))
    whole = F.transform("vector", lambda x: F.round(x * F.when(F.col("origin") == "plain", 1).otherwise(10_000)).cast("long").cast("string"))
    return ask(v.benchmark).select("criterion", "origin", F.array_join(whole, ",").alias("vector"))


#: Documents as a site lists them: twenty a page, firm by firm; titles, files and addresses recur.
_LISTED = """SELECT o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 1000000000 ELSE 0 END AS id, CONCAT('t', CAST(o_custkey % 50 AS STRING)) AS code, CASE WHEN o_orderkey % 2 = 0 THEN '2' ELSE '1' END AS doc_type,
  CAST(2019 + CASE WHEN o_orderkey % 8 > 3 THEN 1 ELSE 0 END AS INTEGER) AS year, CASE WHEN o_orderkey % 2 = 0 THEN CONCAT('Báo cáo thường niên ', CAST(year(o_orderdate) AS STRING)) WHEN o_orderkey % 3 = 0 THEN 'BCTC quý 2 soát xét'
    ELSE CONCAT('Báo cáo tài chính hợp nhất kiểm toán năm ', CAST(year(o_orderdate) AS STRING)) END AS title, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5000 ELSE o_orderkey % 700 END AS file_id,
  CONCAT('u', CAST(o_orderkey % 4 AS STRING)) AS url, o_orderpriority AS source,
  ROW_NUMBER() OVER (PARTITION BY o_custkey % 50, o_orderkey % 2, o_orderkey % 8 > 3 ORDER BY o_orderkey) AS rn, COUNT(*) OVER (PARTITION BY o_custkey % 50, o_orderkey % 2, o_orderkey % 8 > 3) AS total FROM orders"""


def landed_pages(v) -> DataFrame:
    """Pages as ``land`` leaves them: an empty third page of one firm, a failed second one of another."""
    v.orders.createOrReplaceTempView("orders")
    rows = v.spark.sql(_LISTED)
    doc = F.to_json(F.struct(F.col("id").alias("DocumentID"), F.col("title").alias("Title"), F.col("file_id").alias("FileInfoID"), F.col("url").alias("Url"), F.col("source").alias("R_Source"), F.col("total").alias("TotalRow")))
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", doc.alias("doc")))), lambda x: x["doc"]), ","), F.lit("]"))
    pages = rows.groupBy("code", "doc_type", "year", F.expr("cast((rn - 1) div 20 + 1 as int)").alias("page")).agg(listed.alias("answer"))
    empty, failed = F.expr("code = 't3' AND page = 3"), F.expr("code = 't5' AND doc_type = '1' AND page = 2")
    return pages.select("code", "doc_type", "year", "page", F.when(empty, "").when(~failed, F.concat(F.lit('{"Data": '), "answer", F.lit("}"))).alias("answer"), F.when(failed, "timed out").alias("error"))


_FOUND = f"""d AS ({_LISTED}), m AS (SELECT *, max(total) OVER (PARTITION BY code, doc_type) AS most FROM d),
s AS (SELECT *, CASE WHEN file_id IS NOT NULL THEN 'fid:' || file_id ELSE title || '|' || url END AS key FROM m WHERE NOT (code = 't3' AND rn > 40) AND NOT (code = 't5' AND doc_type = '1' AND most > 20)),
a AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY code, doc_type, year, key ORDER BY rn) = 1),
b AS (SELECT * FROM a WHERE doc_type = '2' OR title LIKE '%kiểm toán%' QUALIFY row_number() OVER (PARTITION BY code, doc_type, key ORDER BY year, rn) = 1),
f AS (SELECT id, upper(code) AS ticker, doc_type, title, source, url AS file_url, file_id AS file_info_id, year, rn FROM b WHERE CAST(regexp_extract(title, '[0-9]{{4}}') AS INTEGER) BETWEEN 1993 AND 1997)"""


@query("listing_plan", f"WITH d AS ({_LISTED}) SELECT code, doc_type, year, CAST(ceil(any_value(total) / 20) AS INTEGER) AS n_pages FROM d GROUP BY ALL")
def _(v):
    """How many pages each request has, by its first page."""
    first = landed_pages(v).where("page = 1")
    return first.select("code", "doc_type", "year", L.n_pages(L.items(F.col("answer"))).alias("n_pages"))


@query("listing_documents", f"WITH {_FOUND} SELECT id, ticker, doc_type, title, source, file_url, file_info_id FROM f")
def _(v):
    return L.documents(landed_pages(v), 1993, 1997).select("id", "ticker", "doc_type", "title", "source", "file_url", "file_info_id")


@query(
    "listing_saved",
    f"""WITH {_FOUND},
o AS (SELECT f.id, min(k.id) AS held FROM f JOIN listed_documents k ON k.ticker = f.ticker AND k.doc_type = f.doc_type AND k.file_info_id = f.file_info_id AND k.id <> f.id GROUP BY f.id),
g AS (SELECT coalesce(o.held, f.id) AS row_id, o.held IS NOT NULL AS same_file, f.* FROM f LEFT JOIN o USING (id) QUALIFY row_number() OVER (PARTITION BY coalesce(o.held, f.id) ORDER BY f.year DESC, f.rn DESC, f.id DESC) = 1)
SELECT coalesce(k.id, g.row_id) AS id, coalesce(k.ticker, g.ticker) AS ticker, coalesce(k.doc_type, g.doc_type) AS doc_type, coalesce(g.title, k.title) AS title, coalesce(g.source, k.source) AS source,
  CASE WHEN g.row_id IS NOT NULL AND NOT g.same_file THEN g.file_info_id ELSE k.file_info_id END AS file_info_id, k.synced_to_raw, k.raw_path FROM listed_documents k FULL JOIN g ON k.id = g.row_id""",
)
def _(v):
    """The listing after a sync: rows of the same file or id updated, others added."""
    out = L.saved(v.listed_documents, L.documents(landed_pages(v), 1993, 1997))
    return out.select("id", "ticker", "doc_type", "title", "source", "file_info_id", "synced_to_raw", "raw_path")


def _stored(v, names) -> Store:
    """A store of its own that holds the relations."""
    store = Store(v.spark, f"{ensure_checkpoints(v.spark)}/store-{uuid.uuid4().hex}")
    rows = {n: evolved(getattr(v, n), n) if n.endswith("_jobs") else getattr(v, n) for n in names}
    with ThreadPoolExecutor(C.AT_ONCE) as pool:
        list(pool.map(lambda n: store.write(n, rows[n]), names))
    return store


_GOING = "g AS (SELECT CONCAT('T', c_custkey) AS ticker FROM customer WHERE c_acctbal < 0)"
_STAYING = ["document_embeddings", "inference_results", "proper_vn_results", "governance_results"]


@query(
    "company_delete",
    f"WITH {_GOING} " + " UNION ALL ".join(
        [f"SELECT '{r.table}' AS table_name, COUNT(*) FILTER ({r.keys[0][1]} IN (SELECT ticker FROM g)) AS gone, COUNT(*) FILTER ({r.keys[0][1]} NOT IN (SELECT ticker FROM g)) AS kept, CAST(0 AS BIGINT) AS still_there FROM {r.table}" for r in C.FIRM]
        + [f"SELECT '{t}', 0, COUNT(*), COUNT(*) FILTER (ticker IN (SELECT ticker FROM g)) FROM {t}" for t in _STAYING]
    ),
)
def _(v):
    """Firms in debt are deleted: rows gone and kept in each table, by the written versions; four tables keep theirs."""
    tables = [r.table for r in C.FIRM]
    store = _stored(v, tables + _STAYING)
    going = v.customer.where("c_acctbal < 0").select(F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("ticker"))
    counts = C.delete_companies(store, going)
    firm = {r.table: r.keys[0][1] for r in C.FIRM}
    found = None
    for t in tables + _STAYING:
        rows = store.read(t).join(going.select(F.upper("ticker").alias("g_ticker")), F.col(firm.get(t, "ticker")) == F.col("g_ticker"), "left")
        part = rows.agg(F.count("*").alias("kept"), F.count("g_ticker").alias("still_there")).select(F.lit(t).alias("table_name"), F.lit(counts.get(t, (0, 0))[0]).cast("long").alias("gone"), "kept", "still_there")
        found = part if found is None else found.unionByName(part)
    return found


_ASKED = "q AS (SELECT DISTINCT CONCAT('T', o_custkey) AS ticker, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE o_orderpriority = '1-URGENT')"
_READY = f"""{_ASKED}, n AS (SELECT ticker, TRY_CAST(regexp_extract(title, '([0-9]{{4}})', 1) AS INTEGER) AS year, max_by(raw_path, published_date || lpad(id::VARCHAR, 20, '0')) AS raw FROM listed_documents WHERE synced_to_raw AND raw_path <> '' GROUP BY 1, 2),
d AS (SELECT q.ticker, q.year, coalesce(nullif(j.source_path, ''), n.raw) AS path FROM q LEFT JOIN conversion_jobs j USING (ticker, year) LEFT JOIN n USING (ticker, year)),
y AS (SELECT * FROM d WHERE path IS NOT NULL)"""
_MET = "(ticker, year) IN (SELECT (ticker, year) FROM y)"


@query(
    "reset_downstream",
    f"WITH {_READY} " + " UNION ALL ".join(
        [f"SELECT '{r.table}' AS table_name, COUNT(*) FILTER ({_MET}) AS hit, COUNT(*) FILTER (NOT {_MET}) AS rows, CAST(0 AS BIGINT) AS pending FROM {r.table}" for r in C.DOWNSTREAM if not r.sets]
        + [f"SELECT '{r.table}', COUNT(*) FILTER ({_MET}), COUNT(*), COUNT(*) FILTER ({_MET} OR status = 'pending') FROM {r.table}" for r in C.DOWNSTREAM if r.sets]
        + [f"SELECT 'conversion_jobs', (SELECT COUNT(*) FROM y), (SELECT COUNT(*) FROM y) + COUNT(*) FILTER (NOT {_MET}), (SELECT COUNT(*) FROM y) + COUNT(*) FILTER (NOT {_MET} AND status = 'pending') FROM conversion_jobs",
           "SELECT 'without a file', COUNT(*), 0, 0 FROM d WHERE path IS NULL"]
    ),
)
def _(v):
    """Firm-years with urgent orders start again: rows that went or changed, rows and pending jobs after it."""
    store = _stored(v, [r.table for r in C.DOWNSTREAM] + ["conversion_jobs", "listed_documents"])
    asked = v.orders.where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("ticker"), F.year("o_orderdate").alias("year"))
    counts, lost = C.reset_downstream(store, asked, "rerun")
    row = lambda name, df, hit, pending: df.agg(F.count("*").alias("rows"), pending.alias("pending")).select(F.lit(name).alias("table_name"), hit.cast("long").alias("hit"), "rows", "pending")
    waits, none = F.count_if(F.col("status") == "pending"), F.lit(0).cast("long")
    jobs = store.read("conversion_jobs")
    parts = [row(r.table, store.read(r.table), F.lit(counts[r.table][0]), waits if r.sets else F.max(none)) for r in C.DOWNSTREAM]
    parts += [jobs.agg(F.count("*").alias("rows"), waits.alias("pending"), F.count_if(F.col("rerun_reason") == "rerun").alias("hit")).select(F.lit("conversion_jobs").alias("table_name"), "hit", "rows", "pending")]
    parts += [lost.agg(F.count("*").alias("hit")).select(F.lit("without a file").alias("table_name"), "hit", none.alias("rows"), none.alias("pending"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("table_name", "hit", "rows", F.coalesce("pending", none).alias("pending"))


_SPOILED = """CASE doc_id % 5 WHEN 0 THEN CONCAT('Báo cáo', chr(10), '   V i ệ t N a m c ô n g t y c ổ p h ầ n', chr(10), text) WHEN 1 THEN CONCAT('h0i đồng quả9n trị và c#ng ty', chr(13), 'c@ n7m\u2028', text, ' gi4m đốc') ELSE text END"""
_EDGE = r"(^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$)"


@query(
    "line_hits",
    f"""WITH s AS (SELECT doc_id, {_SPOILED} AS t FROM documents), l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x, i: struct_pack(i := i, x := x)), lambda s: regexp_matches(s.x, '[0-9]')) AS h FROM s)
SELECT doc_id, CAST(len(h) AS INTEGER) AS n_lines, array_to_string(list_transform(h[1:5], lambda s: 'L' || s.i || ': ' || regexp_extract(s.x, '[0-9]+') || ' | ' ||
  CASE WHEN length(regexp_replace(s.x, '{_EDGE}', '', 'g')) > 120 THEN substr(regexp_replace(s.x, '{_EDGE}', '', 'g'), 1, 117) || '...' ELSE regexp_replace(s.x, '{_EDGE}', '', 'g') END), ' ; ') AS examples FROM l""",
)
def _(v):
    """Lines with digits, numbered over all kinds of breaks, and the first five as examples; over whole texts."""
    v.documents.createOrReplaceTempView("documents")
    rows = v.spark.sql(f"SELECT doc_id, {_SPOILED} AS t FROM documents")
    out = A.lines_with(rows, "t", lambda line: line.rlike("[0-9]"), lambda line: F.regexp_substr(line, F.lit("[0-9]+")))
    return out.select("doc_id", F.size("hits").alias("n_lines"), "examples")


@query("quality_evidence")
def _(v):
    """Evidence of broken reports: what each rule found in which lines."""
    v.documents.createOrReplaceTempView("documents")
    rows = v.spark.sql(f"SELECT doc_id, {_SPOILED} AS content FROM documents")
    return A.with_evidence(D.quality(rows)).select("doc_id", "quality_status", "quality_evidence")


@query("reaudit", "SELECT 1 AS run, COUNT(*) AS checked, COUNT(*) AS changed, COUNT(DISTINCT year) AS partitions FROM annual_reports UNION ALL SELECT 2, COUNT(*), 0, 0 FROM annual_reports UNION ALL SELECT 3, COUNT(*), COUNT(*) FILTER (year = 1996), COUNT(DISTINCT year) FILTER (year = 1996) FROM annual_reports")
def _(v):
    """Three audits of the stored reports: the first, one with nothing new, one after the files of a year got a line."""
    path = f"{ensure_checkpoints(v.spark)}/reports-{uuid.uuid4().hex}"
    evolved(v.annual_reports, "annual_reports").write.partitionBy("year").parquet(path)
    grown = v.annual_reports.where("year = 1996").select("source_file", F.concat(F.coalesce("content", F.lit("")), F.lit("\nmore")).alias("content"))
    runs = [A.reaudit(v.spark, path, ["source_file"], sources=s) for s in (None, None, grown)]
    return v.spark.createDataFrame([(i + 1, r["checked"], r["changed"], r["partitions"]) for i, r in enumerate(runs)], "run int, checked long, changed long, partitions long")


_ANSWERS = """SELECT doc_id, CONCAT('T', CAST(doc_id AS STRING)) AS ticker, CAST(1995 + doc_id % 7 AS INTEGER) AS year,
  CASE doc_id % 3 WHEN 0 THEN 'GOV_SUPERVISORY' WHEN 1 THEN 'GOV_DIRECTORY' ELSE 'GOV_SHAREHOLDERS' END AS item_code,
  CASE WHEN doc_id % 2 = 0 THEN 'financial_statement_document_embeddings' ELSE 'document_embeddings' END AS source_table,
  CASE doc_id % 5 WHEN 0 THEN 'oops' WHEN 1 THEN '{"details": [], "value": {}, "reason": "none"}' WHEN 2 THEN '{"details": [{"name": "Ông Trần Văn Bảo", "gender": "male"}], "value": {"a": 1}}' WHEN 3 THEN '{"value": null, "details": null}' END AS raw,
  CONCAT(CASE WHEN doc_id % 7 < 3 THEN 'Ban Kiểm soát Bà Nguyễn Thị An Trưởng ban Ông Trần Văn Bình Thành viên Kiểm toán viên ' WHEN doc_id % 7 < 5 THEN 'Ủy ban kiểm toán Ông Lê Văn Cường Chủ tịch Thuyết minh '
    WHEN doc_id % 7 = 5 THEN 'Ủy ban kiểm toán Ông Đỗ Văn Giang Bà Hoàng Thị Hà Thuyết minh ' ELSE '' END, text) AS text FROM documents"""


@query("text_rosters", "SELECT doc_id, CASE WHEN doc_id % 7 < 3 THEN 'supervisory' WHEN doc_id % 7 < 5 THEN 'committee' WHEN doc_id % 7 = 5 THEN 'committee_next' END AS listed_by, CASE WHEN doc_id % 7 < 3 THEN 'Nguyễn Thị An,Trần Văn Bình' WHEN doc_id % 7 < 5 THEN 'Lê Văn Cường' WHEN doc_id % 7 = 5 THEN 'Đỗ Văn Giang' ELSE '' END AS names FROM documents")
def _(v):
    """Members that whole statement texts list, and by which rule they were read."""
    v.documents.createOrReplaceTempView("documents")
    out = N.text_rosters(v.spark.sql(_ANSWERS).select("doc_id", "text"), F.col("text"))
    return out.select("doc_id", "listed_by", F.array_join(F.transform("listed", lambda m: m["name"]), ",").alias("names"))


@query(
    "governance_answers",
    f"""WITH a AS ({_ANSWERS}), b AS (SELECT *, doc_id % 3 = 0 AS sup, doc_id % 3 < 2 AND doc_id % 2 = 0 AS fs, CASE WHEN doc_id % 5 = 2 THEN 1 ELSE 0 END AS own,
  CASE WHEN doc_id % 7 < 3 THEN 2 WHEN doc_id % 7 < 6 THEN 1 ELSE 0 END AS listed, CASE WHEN doc_id % 7 < 3 THEN 'supervisory' WHEN doc_id % 7 < 5 THEN 'committee' ELSE 'committee_next' END AS via FROM a),
c AS (SELECT *, sup AND own = 0 AND listed > 0 AS fb FROM b), d AS (SELECT *, CASE WHEN fb THEN listed ELSE own END AS n FROM c), e AS (SELECT *, sup AND fs AND listed > n AS longer FROM d)
SELECT ticker, year, CASE WHEN fs THEN item_code || '_FS' ELSE item_code END AS item_code, n > 0 OR longer OR (NOT fs AND (fb OR doc_id % 5 = 2)) AS found, CAST(CASE WHEN longer THEN listed ELSE n END AS INTEGER) AS n_members,
  array_to_string(list_filter([CASE WHEN doc_id % 5 IN (0, 4) THEN 'unparsed' END, CASE WHEN fb THEN 'fallback:' || via END, CASE WHEN fs THEN 'statement' END, CASE WHEN longer THEN 'longer' END], lambda x: x IS NOT NULL), ',') AS provenance FROM e""",
)
def _(v):
    """Stored answers of a batch through the chain of rules."""
    v.documents.createOrReplaceTempView("documents")
    out = N.processed(v.spark.sql(_ANSWERS))
    members = F.when(F.col("details_json") == "null", 0).otherwise(F.json_array_length("details_json"))
    return out.select("ticker", "year", "item_code", "found", members.alias("n_members"), F.array_join("provenance", ",").alias("provenance"))
