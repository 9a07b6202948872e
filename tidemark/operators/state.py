"""Keyed state without MERGE: each change is a new relation; ``sources.store`` writes it as a new version."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _one_of_each(rows: DataFrame, keys: list[str], order: str | None, last: bool) -> DataFrame:
    """The last (or first) row of each key by ``order``, else in the order of the rows; null keys are keys too."""
    by = F.monotonically_increasing_id() if order is None else F.col(order)
    placed = rows.select(*keys, F.struct("*").alias("u_row"), by.alias("u_order"))
    pick = F.max_by if last else F.min_by
    return placed.groupBy(keys).agg(pick("u_row", "u_order").alias("u_row")).select("u_row.*")


def _without(rows: DataFrame, keys_of: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key the other table hasn't; null keys are equal."""
    other = keys_of.select(*[F.col(k).alias(f"u_{k}") for k in keys])
    return rows.join(other, [F.col(k).eqNullSafe(F.col(f"u_{k}")) for k in keys], "left_anti")


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``base`` with rows of the updates' keys replaced, new keys added; of several updates of a key the last one by
    ``order`` stays (without it: the last in the order of the rows).  Null keys are equal to each other."""
    last = _one_of_each(updates, keys, order, True)
    return _without(base, last, keys).unionByName(last, allowMissingColumns=True)


def insert_missing(base: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Conflicts do nothing, so the first row of a new key stays."""
    return base.unionByName(_without(_one_of_each(rows, keys, order, False), base, keys), allowMissingColumns=True)


def upsert_with(base: DataFrame, updates: DataFrame, keys: list[str], rules: dict[str, Column], order: str | None = None) -> DataFrame:
    """Upsert with an expression over old (c) and new (new_c) columns for matched rows; others take the new value."""
    new = _one_of_each(updates, keys, order, True)
    new = new.select(*[F.col(c).alias(f"new_{c}") for c in new.columns], F.lit(True).alias("is_new"))
    both = base.withColumn("is_old", F.lit(True)).join(new, [F.col(k).eqNullSafe(F.col(f"new_{k}")) for k in keys], "full")
    matched, only_new = F.col("is_old") & F.col("is_new"), F.col("is_old").isNull()
    out = []
    for c in base.columns:
        if c in keys:
            out.append(F.when(only_new, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c))
            continue
        new = F.col(f"new_{c}") if c in updates.columns else F.lit(None).cast(base.schema[c].dataType)
        value = rules.get(c, new if c in updates.columns else F.col(c))
        out.append(F.when(matched, value).when(only_new, new).otherwise(F.col(c)).alias(c))
    return both.select(*out)


def finish_jobs(jobs: DataFrame, scanned: DataFrame) -> DataFrame:
    """Jobs after an output scan: a status only rises to completed."""
    done = F.col("new_status") == "completed"
    return upsert_with(jobs, scanned, ["ticker", "year"], {"status": F.when(done, "completed").otherwise(F.col("status"))})


def rescan_jobs(jobs: DataFrame, scanned: DataFrame) -> DataFrame:
    """Jobs after an input scan: completed wins, another source file starts again, the rest stays."""
    done, moved = F.col("new_status") == "completed", F.col("source_path") != F.col("new_source_path")
    rules = {"status": F.when(done, "completed").when(moved, "pending").otherwise(F.col("status"))}
    for c in ("error_message", "failed_step", "pid", "command"):
        if c in jobs.columns:
            rules[c] = F.when(done | moved, None).otherwise(F.col(c))
    return upsert_with(jobs, scanned, ["ticker", "year"], rules)


def with_second_key(base: DataFrame, updates: DataFrame, keys: list[str], file_keys: list[str]) -> DataFrame:
    """Updates with the id of the row that they replace: by id, else by the secondary key; then an upsert by id."""
    by_file = base.where(F.col(file_keys[-1]).isNotNull()).groupBy(file_keys).agg(F.min(keys[0]).alias("file_id"))
    resolved = updates.join(by_file, file_keys, "left").withColumn(keys[0], F.coalesce("file_id", keys[0])).drop("file_id")
    return upsert(base, resolved, keys)


def create_jobs(pairs: DataFrame, jobs: DataFrame, model: str, replace: bool = False) -> DataFrame:
    """Jobs with one for each firm-year: existing ones stay, or start again where ``replace`` is set."""
    keys = ["ticker", "year", "model"]
    wanted = pairs.select("ticker", "year").distinct().withColumns({"model": F.lit(model), "wanted": F.lit(True)})
    both = jobs.select(*keys, "status").join(wanted, keys, "full")
    again = F.col("wanted") & F.col("status").isin("completed", "failed") if replace else F.lit(False)
    return both.select(*keys, F.when(F.col("status").isNull() | F.coalesce(again, F.lit(False)), "pending").otherwise(F.col("status")).alias("status"))


def reset_failed(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("status", F.when(F.col("status") == "failed", "pending").otherwise(F.col("status")))


def sync_states(jobs: DataFrame, results: DataFrame, code: str, total: int) -> DataFrame:
    """Job states from how many items have results: all completed, some pending, none as they are."""
    keys = ["ticker", "year", "model"]
    counts = results.groupBy(keys).agg(F.countDistinct(code).alias("n"))
    n = F.coalesce("n", F.lit(0))
    status = F.when(n >= total, "completed").when((n > 0) & (F.col("status") != "running"), "pending").otherwise(F.col("status"))
    return jobs.join(counts, keys, "left").select(*keys, status.alias("status"), n.alias("done_items"))


def reconcile(jobs: DataFrame, batches: DataFrame, total: int) -> DataFrame:
    """The next state of jobs that wait for a batch (batch_status, n_results)."""
    s, n = F.col("batch_status"), F.coalesce("n_results", F.lit(0))
    after = (
        F.when(F.col("status") != "running", F.col("status"))
        .when(s.isin("failed", "expired", "cancelled"), "failed")
        .when((s == "completed") & (n >= total), "completed")
        .when(s == "completed", "pending")
        .otherwise("running")
    )
    return jobs.join(batches, ["ticker", "year"], "left").withColumn("status", after).select(*jobs.columns)


def delete_where(tables: dict[str, DataFrame], tickers: list[str], columns: dict[str, str] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without the firms' rows, one row for each table with how many go)."""
    columns = columns or {}
    hit = {n: F.coalesce(F.col(columns.get(n, "ticker")).isin(tickers), F.lit(False)) for n in tables}
    counts = [d.where(hit[n]).agg(F.count("*").alias("deleted")).select(F.lit(n).alias("table_name"), "deleted") for n, d in tables.items()]
    return {n: d.where(~hit[n]) for n, d in tables.items()}, reduce(lambda a, b: a.unionByName(b), counts)


def delete_jobs(jobs: DataFrame, results: DataFrame, status: str | None = None, model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(jobs, results) without the jobs of a status and model and without their results."""
    keys = ["ticker", "year", "model"]
    gone = F.lit(True)
    for c, value in (("status", status), ("model", model)):
        gone = gone & (F.col(c) == value) if value else gone
    left = jobs.where(gone).select(keys)
    return jobs.join(left, keys, "left_anti"), results.join(left, keys, "left_anti")


def scoped_delete(results: DataFrame, ticker: str, year: int, codes: list[str]) -> DataFrame:
    """Results without a firm-year's items of these codes; statement-sourced ones (_FS) are codes of their own and stay."""
    gone = (F.col("ticker") == ticker) & (F.col("year") == year) & F.col("item_code").isin(codes)
    return results.where(~F.coalesce(gone, F.lit(False)))


def reset_downstream(tables: dict[str, DataFrame], jobs: dict[str, DataFrame], ticker: str, year: int) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """A firm-year again from the start: derived rows go, its jobs are pending."""
    same = (F.col("ticker") == ticker) & (F.col("year") == year)
    reset = {n: d.withColumn("status", F.when(same, "pending").otherwise(F.col("status"))) for n, d in jobs.items()}
    return {n: d.where(~same) for n, d in tables.items()}, reset


def sync_preview(found: DataFrame, known: DataFrame) -> DataFrame:
    """What a sync would do with each found report: create, update (another source file) or skip."""
    old = known.select("ticker", "year", F.col("source_file").alias("known_file"))
    action = F.when(F.col("known_file").isNull(), "create").when(F.col("known_file") != F.col("source_file"), "update").otherwise("skip")
    return found.join(old, ["ticker", "year"], "left").withColumn("action", action)


def retries(items: DataFrame, most: int, limit: int | None, size: int) -> DataFrame:
    """Failed items with attempts left, in order, in batches within their firm-year; ``limit`` None: all of them."""
    chosen = items.where((F.col("status") == "failed") & (F.col("attempt_count") < most))
    chosen = chosen if limit is None else chosen.orderBy("ticker", "year", "chunk_index").limit(limit)
    place = F.row_number().over(Window.partitionBy("ticker", "year").orderBy("chunk_index"))
    return chosen.withColumn("batch", F.floor((place - 1) / size))


def queue_reruns(jobs: DataFrame, scored: DataFrame, min_garbled: int | None = None) -> DataFrame:
    """Jobs with those of bad reports pending again with forced recognition and the report's reason."""
    bad = scored.where("quality_status = 'fail'") if min_garbled is None else scored.where(F.col("garbled_count") >= min_garbled)
    bad = bad.select("ticker", "year", F.expr("nullif(quality_reason, '')").alias("q"), F.lit(True).alias("hit"))
    hit = F.coalesce("hit", F.lit(False))
    out = jobs.join(bad, ["ticker", "year"], "left")
    changed = {"status": F.when(hit, "pending").otherwise(F.col("status")), "force_ocr": F.col("force_ocr") | hit, "rerun_reason": F.when(hit, F.coalesce("q", F.col("rerun_reason"))).otherwise(F.col("rerun_reason"))}
    return out.withColumns(changed).select(*jobs.columns)


def changed_documents(documents: DataFrame, known: DataFrame) -> DataFrame:
    """Documents whose text's hash is not the known one."""
    hashed = documents.withColumn("content_hash", F.sha2(F.coalesce("content", F.lit("")), 256))
    return hashed.join(known.select("doc_id", "content_hash"), ["doc_id", "content_hash"], "left_anti")


def full_refresh(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new rows; the old ones where a fetch came back empty."""
    return old if new.isEmpty() else new


def replace_tickers(base: DataFrame, rows: DataFrame, key: str = "code") -> DataFrame:
    """All rows of the firms that are among the new ones are replaced."""
    return base.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def sync_targets(firms: DataFrame, stored: DataFrame, key: str = "code", force: bool = False) -> DataFrame:
    """The firms that a sync fetches: all if ``force``, else those without stored rows."""
    return firms if force else firms.join(stored.select(key).distinct(), key, "left_anti")


def sync_requests(firms: DataFrame, low: int, high: int) -> DataFrame:
    """One request for each firm and year of the range; none where the range is empty."""
    years = F.sequence(F.lit(low), F.lit(high)) if low <= high else F.array().cast("array<int>")
    return firms.select("*", F.explode(years).alias("year"))
