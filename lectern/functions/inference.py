"""Models as functions from batches to batches; the engine brings none.

A model is built once per worker process by its factory and then called with whole Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[list], list]


@lru_cache(maxsize=4)
def _loaded(factory: Callable[[], Model]) -> Model:
    return factory()


def infer(column: Column, factory: Callable[[], Model], kind: str) -> Column:
    """The model's answer for each value of the column."""
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _loaded(factory)
        for b in batches:
            yield pd.Series(model(list(b)), dtype=object)

    return run(column)


def stub_transcriber() -> Model:
    """For tests: says how long its input is."""
    return lambda items: [None if x is None else f"{len(x)} units." for x in items]


def stub_embedder(size: int = 8) -> Model:
    """For tests: letter counts as a vector."""
    return lambda items: [None if x is None else [float(sum(ord(c) % size == i for c in x)) for i in range(size)] for x in items]


def cosine(a: str, b: str) -> Column:
    """Cosine of two vector columns, null if one is null or zero."""
    def dot(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def transcribe(df: DataFrame, factory: Callable[[], Model], source: str = "audio", text: str = "text") -> DataFrame:
    return df.withColumn(text, infer(F.col(source), factory, "string"))
