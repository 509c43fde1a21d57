"""Embedders behind one interface, and vectors kept up to date by key.

An embedder is any picklable object with key, dimensions, max_tokens and encode(texts). A chunk's vector
is stale when it has none of the wanted key; stale chunks are encoded in Arrow batches and merged back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.corpus import stale

#: Texts that an embedder gets at once (a fixed value of the published models).
BATCH = 32


class Embedder(Protocol):
    key: str
    dimensions: int
    max_tokens: int

    def encode(self, texts: list[str]) -> np.ndarray:
        """A row of unit length (or zeros) for each text."""


class HashingEmbedder:
    """Words counted by their MD5 modulo the dimensions: deterministic, without a model file."""

    max_tokens = 512

    def __init__(self, dimensions: int = 384, query_prefix: str = ""):
        self.dimensions, self.query_prefix, self.key = dimensions, query_prefix, f"hashing-{dimensions}"

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts, strict=True):
            for w in re.findall("[a-z]+", (text or "").lower()):
                row[int.from_bytes(hashlib.md5(w.encode()).digest(), "big") % self.dimensions] += 1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)


#: Makers of embedders by key; add to it to plug in a model.
EMBEDDERS: dict[str, Callable[[], Embedder]] = {"hashing-384": HashingEmbedder, "hashing-256": lambda: HashingEmbedder(256)}


def embedder(key: str) -> Embedder:
    if key not in EMBEDDERS:
        raise ValueError(f"unknown embedding model {key!r}; known: {', '.join(sorted(EMBEDDERS))}")
    return EMBEDDERS[key]()


def encoded(text: Column | str, model: Embedder, prefix: str = "") -> Column:
    """The vectors of a text column, by Arrow batches; prefix: what the model wants before a query."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            some = [prefix + (t or "") for t in texts]
            parts = [model.encode(some[i : i + BATCH]) for i in range(0, len(some), BATCH)]
            yield pd.Series(list(np.concatenate(parts))) if parts else pd.Series([], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>")(F.col(text) if isinstance(text, str) else text)


def embedded(chunks: DataFrame, model: Embedder, key: str = "chunk_id", text: str = "chunk_text") -> DataFrame:
    """chunks (key, text, embedding, embedding_model ...) with a vector of this model everywhere: stale rows are
    encoded, the others kept as they are. Running it again changes nothing."""
    fresh = stale(chunks, model.key).withColumn("embedding", encoded(text, model)).withColumn("embedding_model", F.lit(model.key))
    current = chunks.filter(F.col("embedding_model").eqNullSafe(F.lit(model.key)))
    return current.unionByName(fresh.select(*chunks.columns))


def searchable(chunks: DataFrame, model: str) -> DataFrame:
    """The chunks that a search by this model may see: no vector of another model is ever compared."""
    return chunks.filter((F.col("embedding_model") == model) & F.col("embedding").isNotNull())


def truncated_share(chunks: DataFrame, tokens: str, limit: int) -> DataFrame:
    """One row: the share of chunks that a model of `limit` tokens would cut."""
    return chunks.agg(F.avg((F.col(tokens) > limit).cast("double")).alias("truncated"))
