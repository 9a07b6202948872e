"""A registry of queries: a function of the views, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(make: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: make(Views(spark, sf_dir))
        if oracle:
            ORACLES[name] = with_views(oracle)
        return make

    return register
