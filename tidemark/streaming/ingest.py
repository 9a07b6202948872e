"""Streams, beyond batch: report files as they arrive, and event counts by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.documents import quality, report_files
from ..operators.state import upsert
from ..sources.files import Store


def event_counts(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events and their value by type and tumbling window; the same plan for a stream and a table."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    counts = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return counts.select(F.col("window.start").alias("window_start"), "event_type", "events", "value")


def reports_into(spark: SparkSession, folder: str, store: Store, checkpoint: str, table: str = "annual_reports") -> StreamingQuery:
    """New markdown files, scored and upserted by (ticker, year); each batch is one new version of the table."""
    root = folder.rstrip("/") + "/"
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))

    def merge(batch: DataFrame, number: int) -> None:
        where = F.regexp_replace(F.url_decode("path"), "^[a-z]+:/*", "/")
        new = quality(report_files(batch.withColumn("path", where), [root])).drop("affected_lines")
        store.write(table, upsert(store.read(table, new.schema.simpleString()[7:-1].replace(":", " ")), new, ["ticker", "year"]))

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
