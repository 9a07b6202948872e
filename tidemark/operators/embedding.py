"""Embedding of report chunks through a provider, and query vectors from hypotheses.

A provider is a function from a list of texts to a list of vectors.  It runs in Arrow batches on the
executors; a batch that it refuses as too large is halved until it fits.  ``hashed`` needs no network.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import vector_mean
from .documents import chunks

BATCH, DIMENSIONS = 512, 64


class TooLarge(Exception):
    """A provider's answer to a batch, or a text, beyond its token limit."""


def hashed(texts: list[str], dimensions: int = DIMENSIONS) -> list[list[float]]:
    """Signed word hashes of unit length: deterministic vectors for tests and offline runs."""
    out = []
    for text in texts:
        v = [0.0] * dimensions
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            v[h % dimensions] += 1.0 if h >> 31 else -1.0
        size = math.sqrt(sum(x * x for x in v))
        out.append([x / size for x in v] if size else v)
    return out


def embed_all(texts: list[str], provider: Callable, batch: int = BATCH, shrink: float = 0.7) -> list[list[float]]:
    """Vectors in order; refused batches are halved, a refused single text is cut to ``shrink`` of its words."""
    out: list[list[float]] = []
    for at in range(0, len(texts), batch):
        todo = [texts[at : at + batch]]
        while todo:
            part = todo.pop()
            try:
                out += provider(part)
            except TooLarge:
                if len(part) > 1:
                    half = len(part) // 2
                    todo += [part[half:], part[:half]]
                else:
                    words = part[0].split()
                    if len(words) <= 1:
                        raise
                    todo.append([" ".join(words[: max(1, int(len(words) * shrink))])])
    return out


def with_embeddings(rows: DataFrame, provider: Callable = hashed, text: str = "chunk_text", batch: int = BATCH) -> DataFrame:
    """``rows`` with an ``embedding`` of their text."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, embedding array<float>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = embed_all([t or "" for t in frame[text]], provider, batch)
            yield frame.assign(embedding=vectors)

    return rows.mapInPandas(run, schema)


def embed_reports(reports: DataFrame, embedded: DataFrame, provider: Callable = hashed, replace: bool = False) -> DataFrame:
    """Chunks with vectors of the reports that have none yet, or of all where ``replace`` is set."""
    todo = reports if replace else reports.join(embedded.select("ticker", "year").distinct(), ["ticker", "year"], "left_anti")
    return with_embeddings(chunks(todo.select("ticker", "year", "content")), provider)


def query_vectors(criteria: DataFrame, provider: Callable = hashed) -> DataFrame:
    """(item, query_vector): the mean of a criterion's vector and those of its hypotheses (item, criterion, hypotheses)."""
    texts = criteria.select("item", F.explode(F.concat(F.array("criterion"), F.coalesce("hypotheses", F.array().cast("array<string>")))).alias("chunk_text"))
    means = vector_mean(with_embeddings(texts, provider), ["item"])
    return means.select("item", F.col("embedding").alias("query_vector"))
