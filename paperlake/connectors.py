"""Interfaces to embedding models, language models and content services, with offline stand-ins.

A connector is an object with one batch method; it is shipped to the executors
and runs in Arrow batches. A task may run twice, so calls must be repeatable;
results are cached in tables by key. The stand-ins are deterministic and need
no network.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Model(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...


class Fetcher(Protocol):
    def fetch(self, keys: list[str]) -> list[str | None]: ...


class HashingEmbedder:
    """Unit vectors of hashed words."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        from paperlake.operators.chunking import hashed_vectors

        return hashed_vectors(texts, self.dim)


class EchoModel:
    """Answers by rules: the first that matches the prompt, else its last line."""

    def __init__(self, rules: list[tuple[str, str]] | None = None):
        self.rules = rules or []

    def complete(self, prompts: list[str]) -> list[str]:
        return [next((a for p, a in self.rules if re.search(p, x)), x.strip().rsplit("\n", 1)[-1]) for x in prompts]


class TableFetcher:
    """Content from a dictionary, for tests and small caches."""

    def __init__(self, table: dict[str, str]):
        self.table = table

    def fetch(self, keys: list[str]) -> list[str | None]:
        return [self.table.get(k) for k in keys]


def retried(call: Callable, attempts: int = 3, wait: float = 2.0, most: float = 10.0):
    """The call's result; failures are repeated with growing pauses, the last one is raised."""
    for n in range(attempts):
        try:
            return call()
        except Exception:
            if n + 1 == attempts:
                raise
            time.sleep(min(most, wait * 2**n))


def embedded(df: DataFrame, text: str, model: Embedder, out: str = "embedding", batch: int = 32) -> DataFrame:
    """``df`` with vectors where ``out`` is missing or null; blank text has a vector of zeros."""
    if out not in df.columns:
        df = df.withColumn(out, F.lit(None).cast("array<float>"))
    df = df.withColumn(out, F.col(out).cast("array<float>"))
    at, vec = df.columns.index(text), df.columns.index(out)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            texts, old = b.column(at).to_pylist(), b.column(vec).to_pylist()
            new = list(old)
            need = [i for i, v in enumerate(old) if v is None]
            for k in range(0, len(need), batch):
                part = [i for i in need[k : k + batch]]
                filled = [i for i in part if (texts[i] or "").strip()]
                vectors = retried(lambda filled=filled: model.embed([texts[i] for i in filled])) if filled else []
                for i, v in zip(filled, vectors):
                    new[i] = [float(x) for x in v]
                for i in set(part) - set(filled):
                    new[i] = [0.0] * model.dim
            cols = [pa.array(new, pa.list_(pa.float32())) if i == vec else b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return df.mapInArrow(run, df.schema)


def completed(df: DataFrame, prompt: str, model: Model, out: str = "answer", batch: int = 8) -> DataFrame:
    """``df`` with the model's answer to each prompt; an error gives null, so that callers fall back."""
    at = df.columns.index(prompt)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            prompts = b.column(at).to_pylist()
            answers: list[str | None] = []
            for k in range(0, len(prompts), batch):
                part = [p or "" for p in prompts[k : k + batch]]
                try:
                    answers += retried(lambda part=part: model.complete(part), wait=0.1)
                except Exception:  # the contract: no answer, not a failed job
                    answers += [None] * len(part)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(answers, pa.string())], [*b.schema.names, out])

    return df.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, {out} string")


def fetched(keys: DataFrame, key: str, source: Fetcher, out: str = "content", batch: int = 32) -> DataFrame:
    """key, content of distinct keys; failures give null."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            ks = b.column(0).to_pylist()
            got: list[str | None] = []
            for k in range(0, len(ks), batch):
                try:
                    got += retried(lambda part=ks[k : k + batch]: source.fetch(part), wait=0.1)
                except Exception:
                    got += [None] * len(ks[k : k + batch])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string())], [key, out])

    return keys.select(key).distinct().mapInArrow(run, f"{key} string, {out} string")
