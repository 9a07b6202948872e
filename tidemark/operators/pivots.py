"""Scores, coverage and pivots over the result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions.text import base_code, big4, code_version
from .templates import latest_by

#: The disclosure checklist: five groups and their item codes.
EDC_GROUPS = {
    "Climate Change": ["CC1", "CC2"],
    "GHG Emissions": ["GHG1", "GHG2", "GHG3", "GHG4", "GHG5", "GHG6", "GHG7"],
    "Energy Consumption": ["EC1", "EC2", "EC3"],
    "GHG Reduction": ["RC1", "RC2", "RC3", "RC4"],
    "GHG Accountability": ["ACC1", "ACC2"],
}
EDC_CODES = [c for codes in EDC_GROUPS.values() for c in codes]
FIRM = ["ticker", "year", "model"]


def _share(valid: Column, total: Column, digits: int = 1) -> Column:
    return F.round(100 * valid / total, digits)


def edc_wide(results: DataFrame) -> DataFrame:
    """One row for each firm-year and model with a 0/1 column for each checklist item and their sum."""
    items = [F.coalesce(F.max(F.when(F.col("category_code") == c, F.col("is_valid").cast("int"))), F.lit(0)).alias(c) for c in EDC_CODES]
    out = results.where(F.col("category_code").isin(EDC_CODES)).groupBy(FIRM).agg(*items)
    return out.withColumn("total_score", sum((F.col(c) for c in EDC_CODES[1:]), F.col(EDC_CODES[0])))


def edc_group_scores(results: DataFrame) -> DataFrame:
    """Valid items of each firm-year by checklist group."""
    group = F.create_map(*[x for g, codes in EDC_GROUPS.items() for c in codes for x in (F.lit(c), F.lit(g))])
    out = results.where(F.col("category_code").isin(EDC_CODES)).withColumn("item_group", group[F.col("category_code")])
    return out.groupBy(*FIRM, "item_group").agg(F.sum(F.col("is_valid").cast("int")).alias("score"), F.count("*").alias("items"))


def grouped_items(results: DataFrame) -> DataFrame:
    """'code=valid' of each firm-year's items by checklist group, in the checklist's order."""
    group = F.create_map(*[x for g, codes in EDC_GROUPS.items() for c in codes for x in (F.lit(c), F.lit(g))])
    place = F.create_map(*[x for i, c in enumerate(EDC_CODES) for x in (F.lit(c), F.lit(i))])
    own = results.where(F.col("category_code").isin(EDC_CODES)).withColumns({"item_group": group[F.col("category_code")], "place": place[F.col("category_code")]})
    item = F.struct("place", F.concat("category_code", F.lit("="), F.col("is_valid").cast("string")).alias("item"))
    return own.groupBy(*FIRM, "item_group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]), ",").alias("items"))


def top_tickers(results: DataFrame, top: int = 20) -> DataFrame:
    """The firms with the most results: valid ones, all and their share."""
    valid, total = F.count_if("is_valid"), F.count("*")
    return results.groupBy("ticker").agg(valid.alias("valid"), total.alias("total"), _share(valid, total).alias("valid_pct")).orderBy(F.desc("total"), "ticker").limit(top)


def checklist(spark) -> DataFrame:
    """The checklist's groups with their items in order."""
    return spark.createDataFrame([(i, g, codes) for i, (g, codes) in enumerate(EDC_GROUPS.items())], "place int, item_group string, codes array<string>")


def checklist_results(results: DataFrame) -> DataFrame:
    """Every item of the checklist with its results; items without any keep one row of nulls."""
    items = checklist(results.sparkSession).select("item_group", F.explode("codes").alias("code"))
    return F.broadcast(items).join(results.withColumnRenamed("category_code", "code"), "code", "left")


def rows_by_model(results: DataFrame) -> DataFrame:
    """How many results each model has, most first."""
    return results.groupBy("model").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "model")


def valid_share(results: DataFrame, by: list[str]) -> DataFrame:
    valid = F.count_if("is_valid")
    return results.withColumn("version", code_version(F.col("category_code"))).groupBy(by).agg(valid.alias("valid"), F.count("*").alias("total"), _share(valid, F.count("*")).alias("valid_pct"))


def compare_variants(standard: DataFrame, variant: DataFrame) -> DataFrame:
    """Valid shares by category in both tables."""
    share = lambda d, n: d.groupBy("category_code").agg(_share(F.count_if("is_valid"), F.count("*")).alias(n))
    own = standard.where(base_code(F.col("category_code")).isin(EDC_CODES))
    out = share(own, "standard_pct").join(share(variant, "variant_pct"), "category_code")
    return out.withColumn("difference", F.round(F.col("variant_pct") - F.col("standard_pct"), 1))


def compare_top_tickers(standard: DataFrame, variant: DataFrame, top: int = 10) -> DataFrame:
    """The same for the firms with the most rows."""
    share = lambda d, n: d.groupBy("ticker").agg(_share(F.count_if("is_valid"), F.count("*")).alias(n))
    most = standard.groupBy("ticker").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "ticker").limit(top)
    out = most.join(share(standard, "standard_pct"), "ticker").join(share(variant, "variant_pct"), "ticker", "left")
    return out.withColumn("variant_pct", F.coalesce("variant_pct", F.lit(0.0)))


def overall(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("rows"), F.countDistinct("ticker").alias("tickers"), F.countDistinct("year").alias("years"), F.countDistinct("category_code").alias("categories"), _share(F.count_if("is_valid"), F.count("*")).alias("valid_pct")
    )


def found_pivot(results: DataFrame, codes: list[str]) -> DataFrame:
    """0/1 for each governance item of a firm-year."""
    return results.groupBy(FIRM).agg(*[F.max(F.when((F.col("item_code") == c) & F.col("found"), 1).otherwise(0)).alias(c) for c in codes])


def item_summary(results: DataFrame) -> DataFrame:
    found = F.count_if("found")
    details = J.array_size(F.col("details_json"))
    return results.groupBy("item_code").agg(
        F.count("*").alias("rows"), found.alias("found_rows"), F.countDistinct("ticker").alias("distinct_tickers"), F.min("year").alias("min_year"), F.max("year").alias("max_year"),
        F.round(F.avg(details), 6).alias("avg_details_count"), F.round(found / F.count("*"), 4).alias("found_rate"),
    )


def gender_summary(results: DataFrame) -> DataFrame:
    """Members by item and gender; members without a name don't count."""
    rows = results.select("item_code", F.explode(J.members(F.col("details_json"))).alias("m")).where("m.name is not null")
    return rows.groupBy("item_code", F.col("m.gender").alias("gender")).agg(F.count("*").alias("rows"))


def big4_breakdown(audits: DataFrame) -> DataFrame:
    label = F.coalesce(big4(F.col("audit_firm")), F.lit("Non-Big4/Unknown"))
    return audits.groupBy(label.alias("label")).agg(F.count("*").alias("rows"), F.countDistinct("ticker").alias("tickers"))


def audit_stats(audits: DataFrame) -> DataFrame:
    return audits.agg(F.count("*").alias("rows"), F.countDistinct("ticker").alias("tickers"), F.min("year").alias("min_year"), F.max("year").alias("max_year"), F.count_if("found").alias("found_rows"))


def run_progress(items: DataFrame) -> DataFrame:
    """Counters, progress and status of each asynchronous run; finished firm-years by a first aggregate."""
    state = lambda s: F.count_if(F.col("status") == s)
    years = items.groupBy("run_id", "ticker", "year").agg(F.count("*").alias("n"), *[state(s).alias(s) for s in ("submitted", "completed", "failed")])
    out = years.groupBy("run_id").agg(
        F.sum("n").alias("total_items"), F.sum("submitted").alias("submitted_items"), F.sum("completed").alias("completed_items"), F.sum("failed").alias("failed_items"),
        F.count_if(F.col("completed") + F.col("failed") == F.col("n")).alias("firm_years_done"), F.count("*").alias("firm_years"),
    )
    c = F.col
    status = (
        F.when(c("submitted_items") > 0, "running")
        .when((c("completed_items") == c("total_items")) & (c("total_items") > 0), "completed")
        .when((c("completed_items") > 0) & (c("failed_items") > 0), "partial_failed")
        .when(c("failed_items") > 0, "failed")
        .when(c("total_items") == 0, "empty")
        .otherwise("pending")
    )
    return out.withColumns({"run_status": status, "progress_pct": F.round(100.0 * (c("completed_items") + c("failed_items")) / c("total_items"), 6)})


def statement_pivot(lines: DataFrame, years: list[int]) -> DataFrame:
    """Line items by fiscal year; of several of a year the one with the latest date, then the last value read (the largest
    where dates are equal) overwrites the others, null or not."""
    year = F.substring("fiscal_date", 1, 4).try_cast("int")
    place = F.struct(F.col("fiscal_date"), F.col("numeric_value"))
    values = [F.max(F.when(year == y, place))["numeric_value"].alias(f"y{y}") for y in years]
    return lines.groupBy("item_code", "label", "display_order").agg(*values)


def ratio_pivot(ratios: DataFrame, code: str, years: list[int]) -> DataFrame:
    """A firm's ratios by group and year: the latest report of a year counts, then its largest value."""
    own = ratios.where(F.col("code") == code).withColumns({"ratio_group": F.coalesce(F.expr("nullif(ratio_group, '')"), F.lit("Other")), "year": F.substring("report_date", 1, 4).try_cast("int")})
    latest = latest_by(own, ["ratio_group", "ratio_code", "year"], [F.desc("report_date"), F.desc_nulls_last("value")])
    return latest.groupBy("ratio_group", "ratio_code").agg(*[F.max(F.when(F.col("year") == y, F.col("value"))).alias(f"y{y}") for y in years])
