"""Files in and out: report folders, CSV targets, batch lines, snapshots, versioned state.

Everything goes through Spark's readers and writers, so a path may be in any store that Spark knows.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import report_files

#: The file name of an annual report PDF.
ANNUAL_PDF = r"^Báo cáo thường niên năm (\d{4})\s*\.pdf$"


def markdown(spark: SparkSession, dirs: list[str]) -> DataFrame:
    """Reports of folders of markdown files, the first folder wins for a ticker and year."""
    parts = [spark.read.text(d, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.lit(d.rstrip("/") + "/").alias("dir"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")) for d in dirs]
    files = reduce(lambda a, b: a.unionByName(b), parts)
    # keep what follows the folder, whatever scheme the reader adds before it
    inside = F.expr("substring(decoded, locate(dir_path, decoded) + length(dir_path))")
    files = files.withColumn("decoded", F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))).withColumn("dir_path", F.regexp_replace("dir", "^[a-z]+:/*", "/"))
    files = files.select(F.concat("dir", inside).alias("path"), "content")
    return report_files(files, [d.rstrip("/") + "/" for d in dirs])


def pdf_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(annual report PDFs with ticker and year, files with other names); contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    parts = F.split(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "/")
    files = files.withColumns({"file_name": F.element_at(parts, -1), "ticker": F.upper(F.element_at(parts, -2))})
    valid = F.col("file_name").rlike(ANNUAL_PDF)
    year = F.regexp_extract("file_name", ANNUAL_PDF, 1).try_cast("int")
    return files.where(valid).withColumn("year", year), files.where(~valid)


def rerun_targets(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, year, reason, cleanup_existing) from a CSV with year lists parted by bars."""
    rows = spark.read.csv(path, header=True).withColumn("ticker", F.upper(F.trim("ticker"))).where("ticker <> ''")
    lists = {"missing": "missing_years", "duplicate": "duplicate_years", "suspicious_small": "suspiciously_small_years"}
    parts = [rows.select("ticker", F.explode(F.split(F.coalesce(c, F.lit("")), r"\|")).alias("y"), F.lit(r).alias("r")) for r, c in lists.items()]
    targets = reduce(lambda a, b: a.unionByName(b), parts).withColumn("year", F.trim("y").try_cast("int")).where("year is not null")
    has = {r: F.bool_or(F.col("r") == r) for r in lists}
    first = F.when(has["duplicate"], "duplicate").when(has["missing"], "missing")
    reason = F.concat_ws("+", first, F.when(has["suspicious_small"], F.lit("suspicious_small")))
    return targets.groupBy("ticker", "year").agg(reason.alias("reason"), (has["duplicate"] | has["suspicious_small"]).alias("cleanup_existing"))


def completed_targets(spark: SparkSession, glob: str) -> DataFrame:
    """Targets that earlier runs report as done."""
    return spark.read.csv(glob, header=True).where("status = 'ok'").select(F.upper(F.trim("ticker")).alias("ticker"), F.col("year").try_cast("int").alias("year")).distinct()


def open_targets(targets: DataFrame, done: DataFrame, tickers: list[str] | None = None, limit: int | None = None) -> DataFrame:
    out = targets.where(F.col("ticker").isin(tickers)) if tickers else targets
    out = out.join(done, ["ticker", "year"], "left_anti").orderBy("ticker", "year")
    return out.limit(limit) if limit else out


def benchmark_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True).select(F.explode("cases").alias("c")).select("c.*")


def batch_requests(prompts: DataFrame, model: str, temperature: float = 0.0) -> DataFrame:
    """One JSON line for each prompt (custom_id, system, prompt) in the layout of chat batches."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.lit(temperature).alias("temperature"), F.array(message("system", "system"), message("user", "prompt")).alias("messages"))
    return prompts.select(F.to_json(F.struct("custom_id", F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))).alias("value"))


def batch_results(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(custom_id, content) of good response lines, (custom_id, error) of the others."""
    status = F.get_json_object("value", "$.response.status_code").try_cast("int")
    rows = lines.select(F.get_json_object("value", "$.custom_id").alias("custom_id"), status.alias("s"), "value")
    good = rows.where("s = 200").select("custom_id", F.coalesce(F.get_json_object("value", "$.response.body.choices[0].message.content"), F.lit("")).alias("content"))
    bad = rows.where("s is null or s <> 200").select("custom_id", F.coalesce(F.get_json_object("value", "$.error.message"), F.get_json_object("value", "$.response.body.error.message"), F.lit("request failed")).alias("error"))
    return good, bad


def listing(pages: DataFrame) -> DataFrame:
    """Documents of listing pages (arrival, FileInfoID, Title, Url, ...): the first of each file or title and address stays."""
    key = F.coalesce(F.col("FileInfoID").cast("string"), F.concat_ws("|", "Title", "Url"))
    row = F.struct(*pages.columns)
    return pages.groupBy(key.alias("document_key")).agg(F.min_by(row, F.col("arrival")).alias("r")).select("r.*")


def in_years(documents: DataFrame, low: int, high: int, year: str = "year") -> DataFrame:
    """Documents of a year range; those without a year stay."""
    return documents.where(F.col(year).isNull() | F.col(year).between(low, high))


def any_case(fields: Column, *names: str) -> Column:
    """The first of some fields of a string map, whatever the case of its keys."""
    small = F.map_from_entries(F.transform(F.map_entries(fields), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    return F.coalesce(*[F.element_at(small, n.lower()) for n in names])


def snake_case(df: DataFrame) -> DataFrame:
    """camelCase columns renamed to snake_case."""
    import re

    return df.select(*[F.col(c).alias(re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", c).lower()) for c in df.columns])


def write_console_csv(df: DataFrame, path: str) -> None:
    """A result as CSV, all values as text and null as nothing."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]).write.mode("overwrite").option("emptyValue", "").csv(path, header=True)


def export(df: DataFrame, path: str, kind: str = "parquet", columns: list[str] | None = None) -> None:
    """A result as csv, json, parquet or workbook, optionally only some columns in order."""
    out = df.select(columns) if columns else df
    writer = out.write.mode("overwrite")
    if kind == "workbook":
        from .sheets import Workbook

        df.sparkSession.dataSource.register(Workbook)
        return writer.format("workbook").save(path)
    {"csv": lambda: writer.csv(path, header=True), "json": lambda: writer.json(path), "parquet": lambda: writer.parquet(path)}[kind]()


class Store:
    """State as Parquet versions below a folder: a change writes a new version, then the pointer moves to it.

    The pointer is itself a small table of versions; the latest complete one counts, so a reader never sees
    half a version and no path is overwritten while it is read.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, name: str) -> str:
        return f"{self.root}/{name}/_versions"

    def write(self, name: str, df: DataFrame) -> int:
        number = (self._latest(name) or (0, ""))[0] + 1
        path = f"{self.root}/{name}/v{number}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        self.spark.createDataFrame([(number, path)], "version int, path string").coalesce(1).write.mode("append").parquet(self._versions(name))
        return number

    def _latest(self, name: str) -> tuple[int, str] | None:
        from pyspark.errors import AnalysisException

        try:
            row = self.spark.read.schema("version int, path string").parquet(self._versions(name)).orderBy(F.desc("version"), "path").first()
        except AnalysisException:
            return None
        return (row.version, row.path) if row else None

    def read(self, name: str, empty: str | None = None) -> DataFrame:
        """The latest version; ``empty``: the schema of a table that has none yet."""
        found = self._latest(name)
        if found:
            return self.spark.read.parquet(found[1])
        if empty is None:
            raise ValueError(f"no table {name}")
        return self.spark.createDataFrame([], empty)


def snapshot(df: DataFrame, path: str, view: str | None = None) -> DataFrame:
    """A Parquet snapshot (also of an empty result) and, if named, a view on it."""
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.parquet(path)
    if view:
        out.createOrReplaceTempView(view)
    return out
