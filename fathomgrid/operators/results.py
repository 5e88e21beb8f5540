"""Shapes of results, injected models, and timings."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Reranker(Protocol):
    """Scores texts against a query; called with batches inside the executors."""

    def __call__(self, query: str, texts: list[str]) -> list[float]: ...


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


def hash_embed(text: str, dims: int = 768) -> np.ndarray:
    """Unit vector of hashed words (FNV-1a, 32 bits); all zero without words. For tests of retrieval without a model."""
    v = np.zeros(dims)
    for word in text.lower().split():
        h = 2166136261
        for c in word:
            h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
        v[h % dims] += 1
    n = np.linalg.norm(v)
    return v / n if n else v


def embedded(rows: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Add `vector` from an embedder that is called with batches of texts; a null text has a null vector."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        there = texts.notna()
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        got = embed(texts[there].tolist()) if there.any() else []
        for i, v in zip(texts.index[there], got):
            out[i] = [float(x) for x in v]
        return out

    return rows.withColumn("vector", run(text))


def reranked(rows: DataFrame, key: str, text: str, query: str, model: Reranker, cache: DataFrame | None = None) -> DataFrame:
    """(key, score): cached scores (key, score) where there are some, the model's for the rest; 0 where a text is null."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model(query, texts.fillna("").tolist()), index=texts.index, dtype="float64").where(texts.notna(), 0.0)

    if cache is None:
        return rows.select(key, run(text).alias("score"))
    hit = rows.select(key).join(cache, key)
    return hit.select(key, "score").unionByName(rows.join(cache.select(key), key, "left_anti").select(key, run(text).alias("score")))


def strong_identity(symbol_id: Column, name: Column, path: Column, line: Column, kind: Column) -> Column:
    """Whether a result says which symbol it is: an identifier, or name, path and line, or kind (no file), name and path."""
    there = lambda c: F.coalesce(c.cast("string") != "", F.lit(False))
    return there(symbol_id) | (there(name) & there(path) & there(line)) | (there(kind) & (F.upper(kind) != "FILE") & there(name) & there(path))


def short(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


class Timings:
    """Seconds and counts of a search's phases."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}
        self.counts: dict[str, int] = {}

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def count(self, name: str, n: int = 1) -> None:
        self.counts[name] = self.counts.get(name, 0) + n

    def __str__(self) -> str:
        return ", ".join([f"{k} {1000 * v:.1f} ms" for k, v in self.seconds.items()] + [f"{k} {v}" for k, v in self.counts.items()])
