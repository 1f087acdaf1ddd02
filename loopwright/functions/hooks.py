"""Batch hooks for model calls: a function over lists of texts, applied in Arrow batches, with deterministic defaults."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Batch = Callable[[list[str]], list]


def batched(hook: Batch, returns: str, size: int = 20) -> Callable[[Column], Column]:
    """A column function that hands texts to the hook, `size` at a time; null texts are handed over as empty."""

    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = s.fillna("").tolist()
            out: list = []
            for i in range(0, len(texts), size):
                out += list(hook(texts[i : i + size]))
            yield pd.Series(out, index=s.index)

    return run


def hashed_embedding(dim: int = 64) -> Batch:
    """A deterministic stand-in for an embedding model: signed word counts, unit length."""
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        rows = []
        for t in texts:
            v = [0.0] * dim
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h >> 31 else -1.0
            n = sum(x * x for x in v) ** 0.5
            rows.append([x / n for x in v] if n else v)
        return rows

    return embed


def same_order(texts: list[str]) -> list[float]:
    """The default reranker: every candidate keeps its place."""
    return [0.0] * len(texts)


def no_conflict(texts: list[str]) -> list[bool]:
    """The default contradiction check."""
    return [False] * len(texts)
