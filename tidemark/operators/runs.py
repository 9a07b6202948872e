"""Runs of a model over stored chunks: choose, submit, collect, review; metadata backfill; model presets.

An item is one chunk of one run.  Batches stay within a firm-year, so numbering them never needs one order of all items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .documents import chunk_metadata, cleaned_metadata, merged_metadata
from .state import upsert_with

CHUNK = ["ticker", "year", "chunk_index"]
#: Fixed states of a batch that will give no answers.
LOST = ["failed", "expired", "cancelled"]


def is_blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def metadata_source(metadata: Column) -> Column:
    """Where stored metadata comes from; ``missing`` without metadata or without the field."""
    return F.coalesce(F.get_json_object(metadata, "$.metadata_source"), F.lit("missing"))


def chosen_chunks(chunks: DataFrame, tickers: list[str] | None = None, years: list[int] | None = None, replace: bool = False, only_other: bool = False) -> DataFrame:
    """The chunks that a run takes: without metadata (unless ``replace``), and not yet made with a model (``only_other``)."""
    found = F.lit(True)
    if tickers:
        found = found & F.col("ticker").isin([t.upper() for t in tickers])
    if years:
        found = found & F.col("year").isin(years)
    if not replace:
        found = found & is_blank(F.col("chunk_metadata_json"))
    if only_other:
        found = found & (metadata_source(F.col("chunk_metadata_json")) != "hybrid")
    return chunks.where(found)


def submitted(chunks: DataFrame, run_id: str, size: int = 8) -> DataFrame:
    """The items of a new run: batches of ``size`` chunks in their order, each with the id its request carries."""
    place = F.row_number().over(Window.partitionBy("ticker", "year").orderBy("chunk_index"))
    part = F.floor((place - 1) / size).cast("int")
    batch = F.concat_ws("-", F.lit(run_id), "ticker", "year", part)
    return chunks.select(F.lit(run_id).alias("run_id"), *CHUNK, batch.alias("batch_id"), F.concat_ws("-", batch, "chunk_index").alias("custom_id"), F.lit("submitted").alias("status"))


def collected(items: DataFrame, batches: DataFrame, answers: DataFrame) -> DataFrame:
    """``items`` after their batches (batch_id, batch_status) and answers (custom_id, answer) came in.

    Only submitted items change: those of a lost batch fail, those of a completed one complete with a JSON answer and
    fail without; others wait.  ``error_message`` says why an item failed, ``answer`` holds what it got.
    """
    both = items.drop("error_message", "answer").join(batches.select("batch_id", "batch_status"), "batch_id", "left").join(answers.select("custom_id", "answer"), "custom_id", "left")
    state, waits = F.col("batch_status"), F.col("status") == "submitted"
    good = F.coalesce(F.get_json_object("answer", "$").startswith("{"), F.lit(False))
    lost, ended = waits & state.isin(LOST), waits & (state == "completed")
    error = F.when(lost, F.concat(F.lit("batch "), state)).when(ended & F.col("answer").isNull(), "no answer").when(ended & ~good, "answer is no JSON object")
    status = F.when(lost | (ended & ~good), "failed").when(ended, "completed").otherwise(F.col("status"))
    return both.select(*[c for c in items.columns if c not in ("status", "error_message", "answer")], status.alias("status"), error.alias("error_message"), F.when(ended & good, F.col("answer")).alias("answer"))


def reviewed(items: DataFrame) -> DataFrame:
    """One row for each run: its items by state, and ``completed`` where none waits, else ``running``."""
    counts = {s: F.count_if(F.col("status") == s).alias(f"{s}_items") for s in ("pending", "submitted", "completed", "failed")}
    out = items.groupBy("run_id").agg(F.count("*").alias("total_items"), *counts.values())
    return out.withColumn("run_status", F.when(F.col("pending_items") + F.col("submitted_items") > 0, "running").otherwise("completed"))


def waiting_chunks(chunks: DataFrame, items: DataFrame, run_id: str, batch_id: str) -> DataFrame:
    """The texts of a run's batch that wait for answers."""
    wanted = items.where((F.col("run_id") == run_id) & (F.col("batch_id") == batch_id) & (F.col("status") == "submitted"))
    return chunks.join(wanted.select(*CHUNK), CHUNK).select(*CHUNK, "chunk_text")


def backfilled(chunks: DataFrame, make: Callable[[Column], Column] = chunk_metadata) -> DataFrame:
    """``chunks`` where blank metadata is made from the text by rules; other metadata stays."""
    own = F.col("chunk_metadata_json")
    return chunks.withColumn("chunk_metadata_json", F.when(is_blank(own), F.to_json(make(F.col("chunk_text")))).otherwise(own))


def regenerated(chunks: DataFrame, provider: Callable[[list[str]], list[str | None]], size: int = 8) -> DataFrame:
    """``chunks`` with metadata by a provider over batches of texts, merged into that by rules.

    Where the provider raises, or returns another number of answers, None or bad JSON, the metadata by rules stands alone.
    """

    def ask(texts: list[str]) -> list[str | None]:
        try:
            answers = list(provider(texts))
        except Exception:  # a provider is outside code; its failures are part of the rule
            answers = []
        return answers if len(answers) == len(texts) else [None] * len(texts)

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            texts = frame["chunk_text"].fillna("").tolist()
            frame["model_json"] = [a for at in range(0, len(texts), size) for a in ask(texts[at : at + size])]
            yield frame

    asked = chunks.select(*CHUNK, "chunk_text").mapInPandas(run, "ticker string, year int, chunk_index int, chunk_text string, model_json string")
    both = asked.withColumns({"m_rules": chunk_metadata(F.col("chunk_text")), "m_model": cleaned_metadata(F.col("model_json"))})
    return both.select(*CHUNK, "chunk_text", F.to_json(merged_metadata(F.col("m_rules"), F.col("m_model"))).alias("chunk_metadata_json"))


def with_presets(presets: DataFrame, task_type: str, models: list[str]) -> DataFrame:
    """``presets`` with these models active; known ones keep when they were made."""
    names = [m.strip() for m in models]
    if not all(names):
        raise ValueError("a model needs a name")
    new = presets.sparkSession.createDataFrame([(task_type, m, True) for m in names], "task_type string, model_name string, is_active boolean")
    return upsert_with(presets, new, ["task_type", "model_name"], {"is_active": F.lit(True)})


def active_presets(presets: DataFrame, task_type: str) -> DataFrame:
    return presets.where((F.col("task_type") == task_type) & F.col("is_active")).orderBy("created_at", "model_name").select("model_name")


def with_metadata(chunks: DataFrame, make: Callable[[Column], Column] = chunk_metadata) -> DataFrame:
    """``chunks`` with ``chunk_metadata_json``: the stored one where the table has that column, else made from the text."""
    if "chunk_metadata_json" in chunks.columns:
        return chunks
    return chunks.withColumn("chunk_metadata_json", F.to_json(make(F.col("chunk_text"))))


def task_items(task: str, items: list[dict[str, str]] | None, known: dict[str, list[dict[str, str]]]) -> list[dict[str, str]]:
    """A task's items: the known ones, or given ones whose code and description are trimmed and not blank."""
    if items is None:
        if task not in known:
            raise ValueError(f"no task {task}")
        return known[task]
    out = []
    for i, item in enumerate(items):
        code, description = (str(item.get(k) or "").strip() for k in ("code", "description"))
        if not code or not description:
            raise ValueError(f"item {i} of {task} needs a code and a description")
        out.append({**item, "code": code, "description": description})
    return out


def plain_codes(codes: list[str], aliases: dict[str, str]) -> list[str]:
    """Codes in their order, aliases by the names that they stand for."""
    return [aliases.get(c, c) for c in codes]
