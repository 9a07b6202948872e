"""Paged REST answers: fetching is a function that the caller gives, so it can be a stub; Spark only sees rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def pages(fetch: Callable[[int], dict], items: str = "data", total: str = "totalPages") -> Iterator[dict]:
    """Items of page 1, 2 and so on until a page is empty or the last one is reached."""
    number = 1
    while True:
        answer = fetch(number) or {}
        rows = answer.get(items) or []
        yield from rows
        if not rows or number >= int(answer.get(total) or 1 << 30):
            return
        number += 1


def fetch_all(keys: DataFrame, key: str, fetch: Callable[[str, int], dict], schema: str) -> DataFrame:
    """Rows of every key's pages; keys are spread over tasks and fetched there as JSON fields named in the schema."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.strip().split(" ")[0] for x in schema.split(",")]
        for frame in frames:
            for k in frame[key]:
                rows = [{**{n: r.get(n) for n in names}, key: k} for r in pages(lambda i: fetch(k, i))]
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return keys.select(key).mapInPandas(run, schema)


def land(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """Fetched rows written once, then read, so that nothing is fetched again."""
    rows.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
