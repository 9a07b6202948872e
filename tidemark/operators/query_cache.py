"""Query vectors from a criterion and its hypotheses, read through a cache.

A vector's key has five parts: the criterion, the embedding model, the dimensions, the language model and the number of
hypotheses; hypotheses have a cache of their own with three of them.  What is asked is joined with the caches; only
misses go to the providers, in Arrow batches on the executors, and each answer is written once, with the next version
of the cache, so nothing is asked twice, neither by a later run nor by a plan that is computed again.

A provider may refuse one criterion (an exception in the batch is tried again one by one): its vector is then the plain
embedding of the criterion, which is given back but not kept as a cache entry, so the next run asks for it again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from ..sources.files import Store

HYPOTHESIS_KEY = ["criterion", "llm_model", "n_documents"]
KEY = ["criterion", "embedding_model", "dimensions", "llm_model", "n_documents"]
#: Hypotheses of a criterion where none are asked for, as a fixed value.
DOCUMENTS = 2

_KEYS = "criterion string, embedding_model string, dimensions int, llm_model string, n_documents int"
HYPOTHESES = "criterion string, llm_model string, n_documents int, hypotheses array<string>"
VECTORS = f"{_KEYS}, vector array<double>, origin string"

#: (criteria, language model, number) -> the hypotheses of each; (texts, model, dimensions) -> the vector of each.
Hypothesise = Callable[[list[str], str, int], list[list[str]]]
Embed = Callable[[list[str], str, int], list[list[float]]]


def requests(criteria: DataFrame, criterion: str, embedding_model: str, dimensions: int, llm_model: str, n_documents: int = DOCUMENTS) -> DataFrame:
    """The keys to ask for: each trimmed criterion with text once."""
    text = F.regexp_replace(F.col(criterion), r"(?U)^\s+|\s+$", "")
    rest = (F.lit(embedding_model).alias("embedding_model"), F.lit(dimensions).alias("dimensions"), F.lit(llm_model).alias("llm_model"), F.lit(n_documents).alias("n_documents"))
    return criteria.select(text.alias("criterion"), *rest).where("criterion <> ''").distinct()


def _each(ask: Callable[[list], list], items: list) -> list:
    """Answers of a batch; where it fails, half by half, and None for those that fail alone."""
    if not items:
        return []
    try:
        answers = ask(items)
        if len(answers) == len(items):
            return answers
    except Exception:  # what a provider may raise is its own
        pass
    if len(items) == 1:
        return [None]
    half = len(items) // 2
    return _each(ask, items[:half]) + _each(ask, items[half:])


def _hypotheses(provider: Hypothesise):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (model, n), part in frame.groupby(["llm_model", "n_documents"], sort=False):
                said = _each(lambda some: provider(some, model, int(n)), part["criterion"].tolist())
                texts = [None if s is None else [t.strip() for t in s if t and t.strip()] for s in said]
                yield part.assign(hypotheses=texts)

    return run


def mean(vectors: list[list[float]]) -> list[float]:
    """The mean of vectors, added in order and then scaled."""
    total = [0.0] * len(vectors[0])
    for vector in vectors:
        total = [a + float(b) for a, b in zip(total, vector)]
    return [x * (1.0 / len(vectors)) for x in total]


def _vectors(provider: Embed):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (model, dimensions), part in frame.groupby(["embedding_model", "dimensions"], sort=False):
                ask = lambda texts: provider(texts, model, int(dimensions))
                # None: no hypotheses could be had, so the plain vector; an empty list is a list
                rows = [(c, None if h is None else [c, *h]) for c, h in zip(part["criterion"], part["hypotheses"])]
                found = _each(lambda some: _means(ask, some), [texts for _, texts in rows if texts])
                full = iter(found)
                mixed = [next(full) if texts else None for _, texts in rows]
                plain = [c for (c, _), v in zip(rows, mixed) if v is None]
                alone = iter(ask(plain) if plain else [])  # what fails here fails the job, as there is no further way
                origin = ["plain" if v is None else "new" for v in mixed]
                vectors = [list(map(float, next(alone))) if v is None else v for v in mixed]
                yield part.drop(columns="hypotheses").assign(vector=vectors, origin=origin)

    return run


def _means(ask: Callable[[list[str]], list], some: list[list[str]]) -> list[list[float]]:
    """One request for all texts of some criteria, then the mean of each."""
    vectors = ask([t for texts in some for t in texts])
    at, out = 0, []
    for texts in some:
        out.append(mean(vectors[at : at + len(texts)]))
        at += len(texts)
    return out


def cached_vectors(store: Store, asked: DataFrame, hypothesise: Hypothesise, embed: Embed, name: str = "query_vectors") -> DataFrame:
    """``asked`` (columns KEY) with ``vector`` and ``origin``: 'cache', 'new', or 'plain' where hypotheses failed.

    Misses are computed once and written: hypotheses to ``{name}_hypotheses``, vectors to ``{name}``.  Where nothing is
    missing, no provider is called and nothing is written.  Null parts of a key match nothing and are left out.
    """
    asked = asked.select(*KEY).dropna().distinct()
    known = store.read(name, VECTORS).where("origin <> 'plain'")
    missing = settle(asked.join(known.select(*KEY), KEY, "left_anti"))
    if not missing.isEmpty():
        told = store.read(f"{name}_hypotheses", HYPOTHESES)
        unheard = missing.select(*HYPOTHESIS_KEY).distinct().join(told.select(*HYPOTHESIS_KEY), HYPOTHESIS_KEY, "left_anti")
        heard = settle(unheard.mapInPandas(_hypotheses(hypothesise), HYPOTHESES))
        good = heard.where("hypotheses IS NOT NULL")
        if not good.isEmpty():
            store.write(f"{name}_hypotheses", told.unionByName(good))
        texts = missing.join(told.unionByName(heard), HYPOTHESIS_KEY)
        fresh = texts.select(*KEY, "hypotheses").mapInPandas(_vectors(embed), VECTORS)
        store.write(name, known.withColumn("origin", F.lit("cache")).unionByName(fresh))
    held = store.read(name, VECTORS)
    once = held.withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy("origin"))).where("place = 1").drop("place")
    found = asked.join(once, KEY).join(missing.withColumn("asked_now", F.lit(True)), KEY, "left")
    return found.select(*KEY, "vector", F.when(F.col("asked_now"), F.col("origin")).otherwise("cache").alias("origin"))
