"""Embedding and rerank providers, their deterministic stand-ins, and the batched stage that calls them."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class TooLarge(Exception):
    """A provider's answer to a batch it can't take."""


class Transient(Exception):
    """A failure worth another attempt; wait: seconds the provider asks for."""

    def __init__(self, message: str = "", wait: float = 0.0):
        super().__init__(message)
        self.wait = wait


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def scores(self, query: str, documents: list[str]) -> list[float]: ...


class HashEmbedder:
    """A vector drawn from a hash of the text, the same everywhere."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        seed = 2166136261
        for b in text.encode("utf-8"):
            seed = ((seed ^ b) * 16777619) & 0xFFFFFFFF
        out = []
        for _ in range(self.dim):
            seed = (seed * 1664525 + 1013904223) & 0xFFFFFFFF
            out.append((seed % 1000) / 1000 + 0.001)
        return out


class OverlapReranker:
    """The share of the query's words that a document has."""

    def scores(self, query: str, documents: list[str]) -> list[float]:
        q = set(query.lower().split())
        return [len(q & set(d.lower().split())) / max(1, len(q)) for d in documents]


def embed_batch(embedder: Embedder, texts: list[str], attempts: int = 5, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random) -> list[list[float]]:
    """Vectors of all texts, checked as a whole. A batch that is too large is halved, down to one text; a
    transient failure is tried again after the wait that the provider asks for, or one that doubles from half
    a second up to 30, of which jitter takes up to a half away so that tasks don't return at once."""
    for n in range(attempts):
        try:
            out = embedder.embed(texts)
            break
        except TooLarge:
            if len(texts) == 1:
                raise
            half = len(texts) // 2
            return embed_batch(embedder, texts[:half], attempts, sleep, jitter) + embed_batch(embedder, texts[half:], attempts, sleep, jitter)
        except Transient as e:
            if n == attempts - 1:
                raise
            sleep(e.wait or min(30.0, 0.5 * 2**n) * (1 - 0.5 * jitter()))
    if len(out) != len(texts) or any(len(v) != embedder.dim for v in out):
        raise ValueError("the provider's answer isn't one vector of the dimension per text")
    return out


def embed(jobs: DataFrame, embedder: Embedder, batch: int = 128, workers: int | None = None) -> DataFrame:
    """(embed_key, v, rejected) of jobs (embed_key, text). Each task calls the provider with batches of its own
    rows; a text that stays too large on its own, or whose vector isn't usable, is rejected (v null)."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                texts = part.column("text").to_pylist()
                try:
                    vectors: list = embed_batch(embedder, texts)
                except TooLarge:
                    vectors = []
                    for t in texts:
                        try:
                            vectors += embed_batch(embedder, [t])
                        except TooLarge:
                            vectors.append(None)
                out = [None if v is None or not np.isfinite(v).all() or not np.any(v) else (np.asarray(v, float) / np.linalg.norm(v)).astype(np.float32) for v in vectors]
                yield pa.RecordBatch.from_arrays([part.column("embed_key"), pa.array(out, pa.list_(pa.float32())), pa.array([v is None for v in out])], names=["embed_key", "v", "rejected"])

    d = jobs.select("embed_key", "text").dropDuplicates(["embed_key"])
    return (d.repartition(workers) if workers else d).mapInArrow(run, "embed_key string, v array<float>, rejected boolean")
