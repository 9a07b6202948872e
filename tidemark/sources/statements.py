"""Statements from folders of markdown files, loaded again only where a file has changed.

The lineage table has a row for each file: its length and time when it was read, the hash of what it held, and the
report that it became.  A sync lists the folder without reading it, and reads the files that are new or whose length or
time differ; a text whose hash is the known one changes nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import markdown_year
from ..session import settle
from .files import Store

#: Changed files that are read by their names; above, the folder is read and joined with them.
MOST_PATHS = 10_000
LINEAGE = "path string, length long, modified timestamp, content_hash string, ticker string, year int, source_file string"
REPORTS = "ticker string, year int, content string, source_file string, created_at timestamp"


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified, ticker, year, source_file) of the markdown files; contents are not read.

    The ticker is the first folder, the year the first from 2000 on in the file's name, its folder's, or its path.
    """
    root = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    bare = "/" + root.split(":", 1)[-1].lstrip("/") if ":" in root else root
    files = files.select("path", "length", F.col("modificationTime").alias("modified"), F.substr(F.col("path"), F.locate(bare, F.col("path")) + len(bare) + 1).alias("inside"))
    parts = F.split("inside", "/")
    stem, parent = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", ""), F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(bare.rsplit("/", 1)[-1]))
    year = F.coalesce(markdown_year(stem), markdown_year(parent), markdown_year(F.col("inside")))
    name = F.concat(F.lit(bare.rsplit("/", 1)[-1] + "/"), F.col("inside"))
    return files.select("path", "length", "modified", F.upper(F.get(parts, F.lit(0))).alias("ticker"), year.alias("year"), name.alias("source_file")).where("year IS NOT NULL")


def _read(spark: SparkSession, folder: str, changed: DataFrame) -> DataFrame:
    """(path, content) of the changed files."""
    few = changed.count() <= MOST_PATHS
    paths = [re.sub(r"([\\{}\[\]*?])", r"\\\1", r.path) for r in changed.select("path").collect()] if few else folder  # no patterns
    texts = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(paths)
    texts = texts.select("path", F.decode("content", "UTF-8").alias("content"))
    return texts if few else texts.join(changed.select("path"), "path", "left_semi")


def sync_statements(store: Store, folder: str, tickers: list[str] | None = None, years: list[int] | None = None, reports: str = "financial_statement_reports", lineage: str = "statement_files") -> dict[str, int]:
    """Load what is new or changed into ``reports``: (files listed, files read, reports written).

    Of several files of a firm-year that are read the last path counts; reports of removed files stay.
    """
    spark = store.spark
    files = listed(spark, folder)
    if tickers:
        files = files.where(F.col("ticker").isin([t.upper() for t in tickers]))
    if years:
        files = files.where(F.col("year").isin(years))
    known = store.read(lineage, LINEAGE)
    seen = known.select("path", "length", "modified")
    changed = settle(files.join(seen, ["path", "length", "modified"], "left_anti"))
    told = {"listed": files.count(), "read": changed.count(), "written": 0}
    if not told["read"]:
        return told
    texts = _read(spark, folder, changed)
    fresh = settle(changed.join(texts, "path").withColumn("content_hash", F.sha2("content", 256)))
    row = F.struct("path", "content", "source_file", "content_hash")
    latest = fresh.groupBy("ticker", "year").agg(F.max(row).alias("r")).select("ticker", "year", "r.*")
    held = known.select("ticker", "year", F.col("source_file").alias("h_file"), F.col("content_hash").alias("h_hash"))
    same = latest.join(held, ["ticker", "year"]).where("h_file = source_file AND h_hash = content_hash").select("ticker", "year").distinct()
    moved = settle(latest.join(same, ["ticker", "year"], "left_anti").select("ticker", "year", "content", "source_file", F.current_timestamp().alias("created_at")))
    told["written"] = moved.count()
    if told["written"]:
        old = store.read(reports, REPORTS)
        store.write(reports, old.join(moved.select("ticker", "year"), ["ticker", "year"], "left_anti").unionByName(moved, allowMissingColumns=True))
    rows = fresh.select(*[c.split()[0] for c in LINEAGE.split(", ")])
    store.write(lineage, known.join(rows.select("path"), "path", "left_anti").unionByName(rows))
    return told
