"""What may be plugged in: embedders, rerankers, sinks of events and parsers, and how their answers are checked.

Providers run on executors, on a batch of rows at a time; what they return is checked before it is used.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.operators.ingestion import EMBED_BATCH, REQUEST_CHARACTERS

# What stands before an embedded text.
DOCUMENT, QUERY = "search_document: ", "search_query: "


class EmbeddingProvider(Protocol):
    identity: tuple[str, str, int]  # provider, model, dimension

    def embed(self, texts: Sequence[str]) -> Sequence[Mapping]:
        """An entry (index, embedding) for each text, in any order."""


class RerankingProvider(Protocol):
    def rerank(self, query: str, documents: Sequence[str], limit: int) -> Sequence[Mapping]:
        """Entries (index, score), the best first."""


class EventSink(Protocol):
    def publish(self, event: str, payload: Mapping[str, object]) -> None: ...


class LanguageParser(Protocol):
    extensions: tuple[str, ...]

    def parse(self, source: str, path: str) -> tuple[list, list]:
        """Entities and edges."""


class NoEvents:
    """A sink that takes events and does nothing."""

    def publish(self, event: str, payload: Mapping[str, object]) -> None:
        return None


class Hashing:
    """An embedder without a model: signed counts of hashed words. Equal texts have equal vectors."""

    def __init__(self, dimension: int = 64):
        self.identity = ("hashing", "words", dimension)

    def embed(self, texts: Sequence[str]) -> list[dict]:
        out = []
        for index, text in enumerate(texts):
            vector = [0.0] * self.identity[2]
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
                vector[h % len(vector)] += 1.0 if h >> 63 else -1.0
            out.append({"index": index, "embedding": vector})
        return out


def checked_embeddings(answer: Sequence[Mapping], texts: int, dimension: int) -> list[list[float]]:
    """An answer's vectors in the order of their texts; an error if it lacks one or has anything else."""
    if not isinstance(answer, Sequence) or len(answer) != texts:
        raise ValueError("an answer needs an embedding for each text")
    out: list[list[float] | None] = [None] * texts
    for entry in answer:
        index, vector = entry.get("index"), entry.get("embedding")
        if not isinstance(index, int) or isinstance(index, bool) or not 0 <= index < texts or out[index] is not None:
            raise ValueError("indexes must be unique and contiguous")
        if not isinstance(vector, Sequence) or len(vector) != dimension:
            raise ValueError(f"an embedding needs {dimension} components")
        if any(isinstance(x, bool) or not isinstance(x, int | float) or not math.isfinite(x) for x in vector):
            raise ValueError("components must be finite numbers")
        out[index] = [float(x) for x in vector]
    return out


def requests(texts: Sequence[str], items: int = EMBED_BATCH, characters: int = REQUEST_CHARACTERS) -> Iterator[tuple[int, int]]:
    """Ranges of successive texts that fit one request; an error for a text that fits none."""
    start = total = 0
    for k, text in enumerate(texts):
        if len(text) > characters:
            raise ValueError("an input is too long for a request")
        if k > start and (k - start >= items or total + len(text) > characters):
            yield start, k
            start, total = k, 0
        total += len(text)
    if len(texts) > start:
        yield start, len(texts)


def embedded(rows: DataFrame, key: str, text: str, make: Callable[[], EmbeddingProvider], prefix: str = DOCUMENT) -> DataFrame:
    """Rows (key, text) as (node_id, vector); a provider is made once for each task and asked in requests of its limits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for batch in batches:
            texts = [prefix + (t or "") for t in batch.column(1).to_pylist()]
            for a, b in requests(texts):
                vectors = checked_embeddings(provider.embed(texts[a:b]), b - a, provider.identity[2])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([np.asarray(v, np.float32) for v in vectors], pa.list_(pa.float32()))], names=["node_id", "vector"])

    return rows.select(key, text).mapInArrow(run, f"node_id {dict(rows.dtypes)[key]}, vector array<float>")


def checked_ranking(answer: Sequence[Mapping], documents: int, limit: int) -> list[tuple[int, float]]:
    """An answer's (index, score), best first; an error for a wrong number, repeats, other indexes, scores that rise."""
    if len(answer) != min(limit, documents):
        raise ValueError("wrong number of results")
    out: list[tuple[int, float]] = []
    for entry in answer:
        index, score = entry["index"], float(entry["score"])
        if not 0 <= index < documents or any(index == i for i, _ in out):
            raise ValueError("indexes must be unique and in range")
        if not math.isfinite(score) or out and score > out[-1][1]:
            raise ValueError("scores must be finite and not rise")
        out.append((index, score))
    return out
