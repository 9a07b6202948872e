"""Retrieval and its evaluation against SQL, brute force and odd rows."""

import math
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tidemark.operators import retrieval as R
from tidemark.operators import search
from tidemark.plans import catalog


def test_evaluation_rounds_and_reads_terms_as_its_sql(spark, tmp_path):
    """5120 texts of a case make shares that end in a half at the tenth digit; a term with a line break is in no text."""
    texts = ["on the way" if i < 41 else "away" for i in range(5120)] + ["a one\ntwo b", "a one two b"]
    ids = [50 * i for i in range(5120)] + [1, 51]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([0, 1], pa.int64()), "text": ["x y z", "x y One\nTwo"]}), tmp_path / "benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = con.sql(catalog.ORACLES["retrieval_eval"]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES["retrieval_eval"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    assert (1, 0.0, 0.0, False) in got


def brute(rows, queries, k):
    """(ticker, item, chunk_index, distance) of the k nearest, by plain Python."""
    out = set()
    for ticker in {t for t, *_ in rows}:
        for item, q in queries:
            found = []
            for t, i, e in rows:
                if t != ticker:
                    continue
                distance = None
                if e is not None and q is not None and len(e) == len(q):
                    norms = math.sqrt(sum(x * x for x in e)) * math.sqrt(sum(x * x for x in q))
                    distance = 1 - sum(x * y for x, y in zip(e, q)) / norms if norms else math.nan
                kind = 2 if distance is None else 1 if math.isnan(distance) else 0
                found.append((kind, distance if kind == 0 else 0, i))
            out |= {(ticker, item, i, None if kind == 2 else "nan" if kind == 1 else d) for kind, d, i in sorted(found)[:k]}
    return out


def test_nearest_chunks_by_brute_force_with_odd_rows(spark, monkeypatch):
    """Copies, null, zero and shorter vectors, in several slices, tasks and blocks of queries."""
    rng = random.Random(4)
    vector = lambda n=8: [rng.randint(-3, 3) / 4 for _ in range(n)]
    odd = [None, [0.0] * 8, vector(5), []]
    same = vector()
    rows = [(f"T{i % 3}", i, odd[i // 3 % 4] if i % 3 == 2 and i < 40 else same if i % 5 == 0 else vector()) for i in range(400)]
    rows += [("few", 1, None), ("few", 2, [0.0] * 8), ("few", 3, vector())]
    queries = [(f"Q{i}", vector()) for i in range(20)] + [("same", same), ("null", None), ("zero", [0.0] * 8), ("short", vector(5))]
    monkeypatch.setattr(search, "SLICE", 32)
    monkeypatch.setattr(search, "SOME", 5)
    monkeypatch.setattr(search, "MOST_QUERIES", 9)
    chunks = spark.createDataFrame([(t, 2000, i, "x", e) for t, i, e in rows], "ticker string, year int, chunk_index int, chunk_text string, embedding array<double>")
    asked = spark.createDataFrame(queries, "item string, query_vector array<double>")
    got = R.batched_top(chunks, asked, 7).collect()
    plain = {(r.ticker, r.item, r.chunk_index, "nan" if r.distance is not None and math.isnan(r.distance) else r.distance) for r in got}
    assert plain == brute(rows, queries, 7) and len(got) == len(plain)
    assert all(r.chunk_text == "x" and r.year == 2000 for r in got)


def test_chunks_and_queries_are_not_paired_as_rows(spark):
    chunks = spark.createDataFrame([("T", 2000, 1, "x", [1.0])], "ticker string, year int, chunk_index int, chunk_text string, embedding array<double>")
    asked = spark.createDataFrame([("Q", [1.0])], "item string, query_vector array<double>")
    asks = asked.selectExpr("item AS query_id", "'x' AS query", "CAST(NULL AS STRING) AS indicator_code", "'x' AS topic", "'EDC' AS framework", "query_vector")
    references = chunks.selectExpr("chunk_index AS chunk_id", "chunk_text", "embedding")
    for df in (R.hybrid_rerank(chunks, "GOV_EXECUTIVE", asked, tag=lambda d: d.selectExpr("*", "array('') AS section_tags", "array('') AS role_tags")), R.batched_top(chunks, asked), R.kb_retrieval(references, asks)):
        assert df.count() == 1
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and not any("query_vector" in line and "embedding" in line for line in plan.splitlines() if "Join" in line or "Window" in line)


def test_references_by_score_and_words(spark):
    """A chunk's words can outweigh a nearer vector; a least score, unsound vectors and ties by id hold."""
    rng = random.Random(7)
    texts = ["cc1 checklist", "CC1 disclosure edc", "cc1", "none"]
    rows = [(f"c{i:03d}", texts[i % 4], [0.0, 0.0] if i == 8 else [1.0] if i == 12 else [float(rng.randint(-2, 2)), rng.randint(1, 3) / 2]) for i in range(120)]
    queries = [(i, "checklist", "CC1" if i % 2 else None, None, "EDC" if i % 3 else "PROPER_VN", [1.0, float(rng.randint(0, 4))]) for i in range(12)]
    references = spark.createDataFrame(rows, "chunk_id string, chunk_text string, embedding array<double>")
    asks = spark.createDataFrame(queries, "query_id long, query string, indicator_code string, topic string, framework string, query_vector array<double>")
    for least in (-1.0, 0.2):
        want = []
        for n, query, code, _, framework, q in queries:
            found = []
            for c, text, e in rows:
                low = text.lower()
                sound = len(e) == 2 and any(e)
                cosine = sum(x * y for x, y in zip(e, q)) / (math.sqrt(sum(x * x for x in e)) * math.sqrt(sum(x * x for x in q))) if sound else -1.0
                words = [query, (code or "").lower(), "", *(R.FRAMEWORK_WORDS[framework])]
                if (code is None or code.lower() in low) and cosine >= least:
                    found.append((-(cosine + 0.01 * sum(w != "" and w in low for w in words)), c))
            want += [(n, c, -s, i + 1) for i, (s, c) in enumerate(sorted(found)[:40])]
        got = R.kb_retrieval(references, asks, 40, least)
        assert {"similarity", "score", "rank", "chunk_text", "framework"} <= set(got.columns) and not {"embedding", "ask"} & set(got.columns)
        assert sorted(tuple(r) for r in got.select("query_id", "chunk_id", "score", "rank").collect()) == sorted(want)
