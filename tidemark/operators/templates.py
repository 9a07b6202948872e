"""The six console templates as operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import json as J
from .dashboards import left_all

FIRM = ["ticker", "year", "model"]
RATIOS = {"TOTAL_ASSETS_AQ": "total_assets", "ROAA_TR_AVG5Q": "roa", "LOANS_TO_ASSET_AQ": "loa"}


def firm_metrics(ratios: DataFrame) -> DataFrame:
    """SIZE, ROA and LOA of each firm-year from the latest value of each ratio."""
    base = ratios.where(F.col("ratio_code").isin(list(RATIOS)) & F.col("value").isNotNull())
    base = base.select(F.col("code").alias("ticker"), F.substring("report_date", 1, 4).try_cast("int").alias("year"), "ratio_code", "report_date", "value")
    # the latest value by a mergeable aggregate: no sort, partial before the shuffle
    latest = [F.max(F.when(F.col("ratio_code") == c, F.struct("report_date", "value"))).getField("value").alias(n) for c, n in RATIOS.items()]
    out = base.groupBy("ticker", "year").agg(*latest)
    return out.select("ticker", "year", F.round(F.ln(F.expr("nullif(total_assets, 0)")), 9).alias("size"), "roa", "loa", "total_assets")


def _item(results: DataFrame, codes: list[str], prefix: str) -> DataFrame:
    return results.where(F.col("item_code").isin(codes)).select(*FIRM, F.col("details_json").alias(f"{prefix}_details"))


def board_metrics(results: DataFrame, audits: DataFrame, directory=("GOV_DIRECTORY",), executive=("GOV_EXECUTIVE",), supervisory=("GOV_SUPERVISORY",), limit: int | None = None) -> DataFrame:
    """Board sizes, women and independent members, audit firm."""
    base = results.select(FIRM).distinct()
    firm = audits.select(*FIRM, J.first_value(J.present(F.col("value_json")), "$.external_audit_firm", "$.external_audit_firm_en").alias("audit_firm"))
    out = left_all(base, [_item(results, list(c), p) for c, p in ((directory, "dir"), (executive, "exe"), (supervisory, "sup"))] + [firm], FIRM)
    d, e, s = F.col("dir_details"), F.col("exe_details"), F.col("sup_details")
    out = out.select(
        *FIRM,
        J.count_where(d, "gender", J.FEMALE).alias("directory_board_female_members"),
        J.count_where(e, "gender", J.FEMALE).alias("executive_board_female_members"),
        J.count_where(d, "is_independent", J.YES).alias("directory_board_independent_members"),
        J.array_size(d).alias("directory_board_size"),
        J.array_size(e).alias("executive_board_size"),
        J.array_size(s).alias("supervisory_board_committee_size"),
        "audit_firm",
    )
    return out.orderBy("ticker", F.desc("year"), "model").limit(limit) if limit else out


def board_profile(results: DataFrame, proper: DataFrame, history: DataFrame, limit: int | None = None) -> DataFrame:
    """Board sizes, firm age, ISO 14001 and women."""
    base = results.select(FIRM).distinct()
    iso = proper.where("indicator_code = 'S2_ISO14001'").groupBy(FIRM).agg(F.max(F.col("is_present").cast("int")).alias("iso"))
    out = left_all(base, [_item(results, [c], p) for c, p in (("GOV_DIRECTORY", "dir"), ("GOV_EXECUTIVE", "exe"), ("GOV_SUPERVISORY", "sup"))] + [iso], FIRM)
    out = out.join(history.select("ticker", "first_event_year"), "ticker", "left")
    out = out.select(
        *FIRM,
        J.array_size(F.col("exe_details")).alias("EXE_BOARDSIZE"),
        J.array_size(F.col("dir_details")).alias("DIR_BOARDSIZE"),
        (F.col("year") - F.col("first_event_year")).alias("AGE"),
        F.coalesce("iso", F.lit(0)).alias("ISO"),
        J.count_where(F.col("dir_details"), "gender", J.FEMALE).alias("WOMAN"),
        J.array_size(F.col("sup_details")).alias("SUPERVISOR"),
        J.count_where(F.col("sup_details"), "gender", J.FEMALE).alias("SUPERVISOR_WOMAN"),
    )
    return out.orderBy("ticker", F.desc("year"), "model").limit(limit) if limit else out


PROPER_FLAGS = {
    "S2_CARBON_DISC": "proper_carbon_disclosure",
    "S2_REDUCTION": "proper_emission_reduction",
    "S2_EFFICIENCY": "proper_resource_efficiency",
    "S2_ISO14001": "proper_iso14001",
    "S1_COMPLIANCE": "proper_env_compliance",
    "S1_MINOR_NC": "proper_minor_non_compliance",
    "S1_VIOLATION": "proper_env_violation",
}
GHG_FLAGS = {
    "GHG1": "ghg1_methodology",
    "GHG2": "ghg2_external_verification",
    "GHG3": "ghg3_total_emissions",
    "GHG4": "ghg4_scope_disclosure",
    "GHG5": "ghg5_by_source",
    "GHG6": "ghg6_by_facility",
    "GHG7": "ghg7_historical_comparison",
}


def _flags(df: DataFrame, code: str, true: str, names: dict[str, str], valid: str, total: str) -> DataFrame:
    flags = [F.max(F.when((F.col(code) == c) & F.col(true), 1).otherwise(0)).alias(n) for c, n in names.items()]
    return df.groupBy(FIRM).agg(*flags, F.count_if(true).alias(valid), F.count("*").alias(total))


def carbon_proper(proper: DataFrame, edc: DataFrame, limit: int | None = None) -> DataFrame:
    """PROPER-VN and GHG disclosure flags side by side."""
    p = _flags(proper, "indicator_code", "is_present", PROPER_FLAGS, "proper_present_count", "proper_total_indicators")
    g = _flags(edc.where(F.col("category_code").isin(list(GHG_FLAGS))), "category_code", "is_valid", GHG_FLAGS, "edc_ghg_valid_count", "edc_ghg_total_count")
    out = p.join(g, FIRM, "full")
    out = out.select(*FIRM, *[F.coalesce(c, F.lit(0)).alias(c) for c in out.columns if c not in FIRM])
    return out.orderBy("ticker", F.desc("year"), "model").limit(limit) if limit else out


def item_coverage(results: DataFrame) -> DataFrame:
    return results.groupBy("item_code").agg(F.count("*").alias("rows_count"), F.countDistinct("ticker").alias("ticker_count")).orderBy(F.desc("rows_count"), "item_code")


def latest_results(results: DataFrame, limit: int = 100) -> DataFrame:
    return results.select("ticker", "year", "item_code", "model", "created_at").orderBy(F.desc("created_at"), "ticker", "year", "item_code").limit(limit)


def latest_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order; the group-limited window sorts no more than it must."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("nth", nth).where("nth = 1").drop("nth")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
