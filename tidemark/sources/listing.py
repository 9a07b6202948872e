"""Paged document listings: pages planned from the first one, landed as they came, then read as relations.

A site answers a request (code, doc_type, year, page) with a JSON list, or an object that holds one; each document may
name the number of all rows (``TotalRow``), from which the further pages follow.  ``fetch`` is the caller's function, so
it can be a stub.  ``land`` spreads requests over tasks, first pages, then the pages they announce, and keeps every
answer in a store; a run that is begun again fetches only what has not landed.  ``documents`` never asks the site.

``listing_source`` is the same for one request as a data source: ``spark.dataSource.register(listing_source(fetch))``,
then ``spark.read.format("paged_listing").option("code", ...)``, with one partition for each page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import audited_annual, title_year
from ..session import settle
from .files import Store, any_case

#: Documents of a full page, and the types of documents, as fixed values.
PAGE_ROWS, ANNUAL_REPORT, AUDITED_STATEMENT = 20, "2", "1"
#: Requests of a task.
REQUESTS = 64

REQUEST = "code string, doc_type string, year int"
PAGES = f"run_id string, {REQUEST}, page int, answer string, error string"
_KEY = ["run_id", "code", "doc_type", "year", "page"]

#: (code, doc_type, year or None, page) -> the answer's text.
Fetch = Callable[[str, str, "int | None", int], "str | None"]


def items(answer: Column) -> Column:
    """The documents of an answer as string maps: a list, the first list in an object, or the object itself."""
    rows = "array<map<string,string>>"
    text = F.trim(F.coalesce(answer, F.lit("")))
    whole = F.from_json(text, "map<string,string>")
    inner = F.filter(F.transform(F.map_values(whole), lambda v: F.when(v.startswith("["), F.from_json(v, rows))), lambda x: F.size(F.filter(x, lambda y: y.isNotNull())) > 0)
    of_object = F.when(F.size(inner) > 0, F.get(inner, F.lit(0))).when(F.size(F.map_keys(whole)) > 0, F.array(whole))
    found = F.when(text.startswith("["), F.from_json(text, rows)).when(text.startswith("{"), of_object)
    return F.filter(F.coalesce(found, F.array().cast(rows)), lambda x: x.isNotNull())


def n_pages(found: Column, page_rows: int = PAGE_ROWS) -> Column:
    """How many pages the first page announces; one where it names no number."""
    rows = F.coalesce(F.get(found, F.lit(0))["TotalRow"].try_cast("long"), F.lit(0))
    return F.when(F.size(found) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(rows / page_rows))).cast("int")


def _asked(fetch: Fetch):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers, errors = [], []
            for r in frame.itertuples(index=False):
                try:
                    answer, error = fetch(r.code, r.doc_type, None if pd.isna(r.year) else int(r.year), int(r.page)) or "", None
                except Exception as failure:  # one page's failure is its firm's, not the job's
                    answer, error = None, str(failure) or type(failure).__name__
                answers.append(answer)
                errors.append(error)
            yield frame.assign(answer=answers, error=errors)

    return run


def _fetched(wanted: DataFrame, fetch: Fetch) -> DataFrame:
    """Answers for (run_id, code, doc_type, year, page), computed once."""
    wanted = settle(wanted.select(*_KEY))
    return settle(wanted.repartition(max(1, -(-wanted.count() // REQUESTS))).mapInPandas(_asked(fetch), PAGES))


def _absent(wanted: DataFrame, landed: DataFrame) -> DataFrame:
    """What has not landed without an error; a null year is a year."""
    done = landed.where("error IS NULL").select(*[F.col(c).alias(f"l_{c}") for c in _KEY])
    return wanted.join(done, [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in _KEY], "left_anti")


def land(store: Store, requests: DataFrame, fetch: Fetch, run_id: str, page_rows: int = PAGE_ROWS, name: str = "listing_pages") -> DataFrame:
    """All pages of the requests (code, doc_type, year), in the store; failed pages have an ``error``."""
    landed = store.read(name, PAGES)
    asked = requests.select(F.lit(run_id).alias("run_id"), "code", "doc_type", F.col("year").cast("int").alias("year")).distinct()

    def keep(more: DataFrame) -> None:
        """A page that is fetched again takes the place of its failure."""
        nonlocal landed
        if not more.isEmpty():
            again = more.select(*[F.col(c).alias(f"l_{c}") for c in _KEY])
            others = landed.join(again, [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in _KEY], "left_anti")
            store.write(name, others.unionByName(more))
            landed = store.read(name)

    keep(_fetched(_absent(asked.withColumn("page", F.lit(1)), landed), fetch))
    last = n_pages(items(F.col("answer")), page_rows)
    of_run = landed.where((F.col("run_id") == run_id) & (F.col("page") == 1) & F.col("error").isNull())
    further = of_run.withColumn("last", last).where("last > 1").withColumn("page", F.explode(F.expr("sequence(2, last)")))
    keep(_fetched(_absent(further, landed), fetch))
    return landed.where(F.col("run_id") == run_id)


def first_ones(found: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each document: its FileInfoID, else title and address."""
    file_id = F.trim(F.coalesce(F.col("doc")["FileInfoID"], F.lit("")))
    fallback = F.concat(F.lit("fallback:"), F.coalesce(F.col("doc")["Title"], F.lit("")), F.lit("|"), F.coalesce(F.col("doc")["Url"], F.lit("")))
    key = F.when(file_id != "", F.concat(F.lit("fid:"), F.col("doc")["FileInfoID"])).otherwise(fallback)
    row = F.struct(*found.columns)
    return found.groupBy(*keys, key.alias("doc_key")).agg(F.min_by(row, F.struct(*order)).alias("r")).select("r.*")


def documents(pages: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """The listed documents of landed pages (code, doc_type, year, page, answer, error) in the store's columns.

    Pages after an empty one don't count; a firm and type with a failed page has none.  Of a document that comes
    again on a later place, page or year the first stays; of audited statements only those of a year.  Documents with
    a title year outside ``low`` to ``high`` go, those without one stay.  ``place`` gives the order of arrival.
    """
    request = ["code", "doc_type", "year"]
    pages = pages.select(*request, "page", "error", items(F.col("answer")).alias("docs"))
    per_request, per_firm = Window.partitionBy(*request), Window.partitionBy("code", "doc_type")
    ends = F.min(F.when(F.size("docs") == 0, F.col("page"))).over(per_request)
    fails = F.max(F.col("error").isNotNull()).over(per_firm)
    sound = pages.withColumn("ends", ends).withColumn("fails", fails).where("NOT fails AND (ends IS NULL OR page < ends)")
    found = sound.select(*request, "page", F.posexplode("docs").alias("at", "doc"))
    once = first_ones(found, request, ["page", "at"])
    said = lambda *names: F.coalesce(*[F.nullif(F.col("doc")[n], F.lit("")) for n in names])
    once = once.where((F.col("doc_type") != AUDITED_STATEMENT) | audited_annual(said("Title", "R_Title"), said("FullName", "R_FullName")))
    once = first_ones(once, ["code", "doc_type"], ["year", "page", "at"])
    ids = F.filter(F.map_entries("doc"), lambda e: (F.lower(e["key"]).contains("documentid") | (F.lower(e["key"]) == "id")) & e["value"].isNotNull())
    field = lambda *names: F.coalesce(any_case(F.map_filter("doc", lambda k, v: v != ""), *names), F.lit(""))
    out = once.select(
        F.coalesce(F.get(ids, F.lit(0))["value"].try_cast("long"), F.pmod(F.xxhash64(F.to_json("doc")), F.lit(10**9))).alias("id"),
        F.upper("code").alias("ticker"), "doc_type", field("R_Title", "Title").alias("title"), field("R_FullName", "FullName", "full_name").alias("full_name"),
        field("R_Source", "Source").alias("source"), field("R_DateTime", "DateTime", "date", "published_date", "UpdateTime", "LastUpdate").alias("published_date"),
        field("R_FileURL", "FileURL", "file_url", "Url").alias("file_url"), field("FileInfoID", "R_FileInfoID").try_cast("long").alias("file_info_id"),
        F.struct("year", "page", "at").alias("place"),
    )
    year = title_year(F.col("title"))
    return out.where(year.isNull() | ((year >= low) if low is not None else F.lit(True)) & ((year <= high) if high is not None else F.lit(True)))


def saved(known: DataFrame, found: DataFrame) -> DataFrame:
    """The store's listing after the found documents: a document of a known firm, type and file takes that row's place,
    another that of its id, a new one is added; of several for a row the last to arrive counts."""
    named = ["title", "full_name", "source", "published_date", "file_url"]
    held = known.where("file_info_id IS NOT NULL").groupBy("ticker", "doc_type", "file_info_id").agg(F.min("id").alias("held_id"), F.collect_set("id").alias("ids"))
    target = found.join(held, ["ticker", "doc_type", "file_info_id"], "left")
    others = F.filter("ids", lambda x: x != F.col("id"))
    target = target.withColumn("same_file", F.coalesce(F.size(others) > 0, F.lit(False)))
    target = target.withColumn("row_id", F.when(F.col("same_file"), F.array_min(others)).otherwise(F.col("id")))
    last = target.groupBy(F.col("row_id").alias("id")).agg(F.max_by(F.struct("ticker", "doc_type", "same_file", "file_info_id", *named), F.col("place")).alias("n"))
    both = known.join(last, "id", "full")
    fresh = F.col("ticker").isNull()  # every known row has a firm
    out = []
    for c in known.columns:
        if c in named:
            value = F.when(F.col("n").isNotNull(), F.col("n")[c]).otherwise(F.col(c))
        elif c == "file_info_id":  # only a row that is found by its id takes the file over
            value = F.when(F.col("n").isNotNull() & ~F.col("n.same_file"), F.col("n")[c]).otherwise(F.col(c))
        elif c in ("ticker", "doc_type"):
            value = F.when(fresh, F.col("n")[c]).otherwise(F.col(c))
        else:
            value = F.col(c)
        out.append(value.alias(c))
    return both.select(*out)


def progress(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(ticker, n_saved, error) of each firm of a run."""
    firms = pages.groupBy(F.upper("code").alias("ticker")).agg(F.min("error").alias("error"))
    counts = found.groupBy("ticker").agg(F.count("*").alias("n_saved"))
    return firms.join(counts, "ticker", "left").select("ticker", F.coalesce("n_saved", F.lit(0)).alias("n_saved"), "error")


def listing_source(fetch: Fetch, page_rows: int = PAGE_ROWS) -> type[DataSource]:
    """A data source over one request's pages: (page, answer)."""

    class Page(InputPartition):
        def __init__(self, page: int, answer: str | None):
            self.page, self.answer = page, answer

    class Reader(DataSourceReader):
        def __init__(self, code: str, doc_type: str, year: int | None):
            self.request = (code, doc_type, year)

        def partitions(self) -> list[InputPartition]:
            """Page 1 with its answer, and those that its TotalRow announces."""
            import json

            first = fetch(*self.request, 1) or ""
            try:
                told = json.loads(first)
                rows = told if isinstance(told, list) else next((v for v in told.values() if isinstance(v, list) and v), [told])
                total = int(rows[0].get("TotalRow") or 0) if rows else 0
            except (ValueError, TypeError, AttributeError):
                total = 0
            return [Page(1, first), *(Page(i, None) for i in range(2, -(-total // page_rows) + 1))]

        def read(self, partition: Page) -> Iterator[tuple]:
            yield partition.page, partition.answer if partition.answer is not None else fetch(*self.request, partition.page) or ""

    class PagedListing(DataSource):
        @classmethod
        def name(cls) -> str:
            return "paged_listing"

        def schema(self) -> str:
            return "page int, answer string"

        def reader(self, schema) -> DataSourceReader:
            year = self.options.get("year")
            return Reader(self.options["code"], self.options.get("doc_type", ANNUAL_REPORT), int(year) if year else None)

    return PagedListing
