"""A read-only SQL console over the report relations, and its command line."""

from __future__ import annotations

import argparse
import re

from pyspark.sql import DataFrame, SparkSession

from .plans import catalog
from .plans.views import TABLES, VIEWS, Views

READ_ONLY = ("select", "with", "show", "describe", "explain", "summarize")
TEMPLATES = {
    "Governance Board Metrics": "gov_board_metrics",
    "Latest Governance Results": "latest_gov_results",
    "Governance Item Coverage": "gov_item_coverage",
    "Firm Metrics (SIZE/ROA/LOA)": "firm_metrics",
    "Board/Governance Profile": "board_profile",
    "Carbon Disclosure + PROPER-VN": "carbon_proper",
}


def guard(text: str) -> str:
    """The statement, if it is one read-only statement; else an error that says why not."""
    sql = (text or "").strip()
    if not sql:
        raise ValueError("Query is empty")
    sql = sql.rstrip(";").rstrip()
    if ";" in sql:
        raise ValueError("Only one SQL statement is allowed")
    if not sql.lower().startswith(READ_ONLY):
        raise ValueError("Only read-only SQL is allowed (SELECT/WITH/SHOW/DESCRIBE/SUMMARIZE/EXPLAIN)")
    if re.match(r"(?is)with\b", sql) and re.search(r"(?i)\b(insert|overwrite)\b\s+(into|table|directory)", sql):
        raise ValueError("Only read-only SQL is allowed")
    return sql


class Console:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.views, self.sf_dir = spark, Views(spark, sf_dir), sf_dir

    def run(self, text: str) -> DataFrame:
        """The statement's rows; only the relations that it names are resolved."""
        sql = guard(text)
        for name in [*TABLES, *VIEWS]:
            if re.search(rf"\b{name}\b", sql):
                getattr(self.views, name).createOrReplaceTempView(name)
        if m := re.match(r"(?is)summarize\s+(.+)", sql):
            inner = m[1].strip()
            return (self.spark.sql(inner) if re.match(r"(?is)(select|with)\b", inner) else self.spark.table(inner)).summary()
        return self.spark.sql(sql)

    def template(self, title: str) -> DataFrame:
        return catalog.QUERIES[TEMPLATES[title]](self.spark, self.sf_dir)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Queries over report relations")
    parser.add_argument("folder", help="folder of the Parquet tables")
    task = parser.add_mutually_exclusive_group(required=True)
    task.add_argument("--sql")
    task.add_argument("--query", choices=sorted(catalog.QUERIES))
    task.add_argument("--template", choices=sorted(TEMPLATES))
    parser.add_argument("--csv", help="write the result to this folder instead of showing it")
    given = parser.parse_args(arguments)
    from .session import session

    spark = session()
    console = Console(spark, given.folder)
    if given.sql:
        out = console.run(given.sql)
    else:
        out = catalog.QUERIES[given.query](spark, given.folder) if given.query else console.template(given.template)
    if given.csv:
        from .sources.files import write_console_csv

        write_console_csv(out, given.csv)
    else:
        out.show(50, truncate=60)


if __name__ == "__main__":
    main()
