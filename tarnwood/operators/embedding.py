"""Embedding providers: a registry, batching, deduplication, and a deterministic provider."""

from __future__ import annotations

from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwood.functions.arrow import map_columns
from tarnwood.model import InvalidRequest, check_vector

# The hash's start and prime, and the step between dimensions.
OFFSET, PRIME, STEP = 0xCBF29CE484222325, 0x100000001B3, 0x9E3779B97F4A7C15


class Provider(Protocol):
    name: str
    max_batch: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Deterministic:
    """A hash of the text for each dimension; its upper 24 bits spread over -1 to 1."""

    def __init__(self, dimension: int, max_batch: int = 256):
        if dimension <= 0:
            raise InvalidRequest("dimension must be positive")
        self.name, self.dimension, self.max_batch = "deterministic", dimension, max_batch

    def embed(self, texts: list[str]) -> list[list[float]]:
        """All texts of a batch advance together, a byte position at a time."""
        data = [t.encode() for t in texts]
        with np.errstate(over="ignore"):
            start = np.uint64(OFFSET) ^ (np.arange(self.dimension, dtype=np.uint64) * np.uint64(STEP))
            state = np.tile(start, (len(data), 1))
            order = np.argsort([-len(d) for d in data], kind="stable")
            length = np.array([len(data[i]) for i in order])
            padded = np.zeros((len(data), int(length.max(initial=0))), np.uint64)
            for row, i in enumerate(order):
                padded[row, : len(data[i])] = np.frombuffer(data[i], np.uint8)
            for at in range(padded.shape[1]):
                live = int(np.searchsorted(-length, -at, side="left"))  # texts longer than `at`
                state[:live] = (state[:live] ^ padded[:live, at : at + 1]) * np.uint64(PRIME)
        value = (((state >> np.uint64(40)) & np.uint64(0xFFFFFF)).astype(np.float32) / np.float32(16_777_215.0)) * np.float32(2) - np.float32(1)
        value[~value.any(1), 0] = 1.0
        out = np.empty_like(value)
        out[order] = value
        return out.astype(float).tolist()


class Registry:
    def __init__(self):
        self._held: dict[str, object] = {}

    def register(self, profile: str, provider: object) -> None:
        if not profile.strip() or profile in self._held:
            raise InvalidRequest("a profile's name is unique and not blank")
        self._held[profile] = provider

    def get(self, profile: str) -> object:
        if profile not in self._held:
            raise InvalidRequest(f"unknown profile {profile}")
        return self._held[profile]

    def names(self) -> list[str]:
        return sorted(self._held)


def embed_checked(provider: Provider, texts: list[str], dimension: int) -> list[list[float]]:
    out = []
    for at in range(0, len(texts), provider.max_batch):
        part = provider.embed(texts[at : at + provider.max_batch])
        if len(part) != len(texts[at : at + provider.max_batch]):
            raise ValueError("the provider gave another number of vectors")
        out += [check_vector(v, dimension) for v in part]
    return out


def embed(df: DataFrame, provider: Provider, dimension: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, vector); equal texts of a batch are embedded once. A null text counts as empty."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def work(columns):
        unique = {t or "": None for t in columns[1]}
        unique = dict(zip(unique, embed_checked(provider, list(unique), dimension), strict=True))
        return columns[0], [unique[t or ""] for t in columns[1]]

    return map_columns(df, [key, text], schema, work)


def embed_cached(df: DataFrame, cache: DataFrame, provider: Provider, dimension: int, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, vector) through a cache table (hash, vector), and the rows to add to the cache.

    Each distinct text that the cache lacks is embedded once, by a shuffle on its hash."""
    hashed = df.withColumn("hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    misses = hashed.select("hash", text).dropDuplicates(["hash"]).join(cache, "hash", "left_anti")
    fresh = embed(misses, provider, dimension, "hash", text)
    known = cache.select("hash", "vector").unionByName(fresh)
    return hashed.select(key, "hash").join(known, "hash").select(key, "vector"), fresh
