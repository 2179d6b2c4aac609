"""Pluggable chat, embedding, rerank and retrieval providers, with deterministic stand-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.lexical import top

_REGISTRY: dict[str, dict[str, Callable]] = {"retriever": {}, "reranker": {}, "embedder": {}, "index": {}, "chat": {}}


def register(kind: str, name: str, provider: Callable) -> None:
    """Adds a provider; kinds are fixed, a name taken again is replaced."""
    if kind not in _REGISTRY:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(_REGISTRY)}")
    if not callable(provider):
        raise TypeError("a provider must be callable")
    _REGISTRY[kind][name] = provider


def provider(kind: str, name: str) -> Callable:
    if kind not in _REGISTRY:
        raise ValueError(f"unknown kind {kind!r}")
    return _REGISTRY[kind][name]


def providers(kind: str) -> list[str]:
    return sorted(_REGISTRY[kind])


def hashed_vector(text: str, dim: int) -> np.ndarray:
    """A unit vector that depends on the text alone."""
    seed = xxhash.xxh64_intdigest(text.encode())
    v = np.random.default_rng(seed).uniform(-1, 1, dim)
    return v / np.linalg.norm(v)


def hashed_embedder(rows: DataFrame, key: str, text: str, dim: int = 384) -> DataFrame:
    """(key, embedding) by `hashed_vector`: stands in for an embedding model; null texts are left out."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [hashed_vector(t, dim).astype(np.float32) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(v, pa.list_(pa.float32()))], ["k", "embedding"])

    return rows.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, embedding array<float>").withColumnRenamed("k", key)


def quoting_chat(question: Column) -> Column:
    """Stands in for a chat model: the start of the question behind a mark."""
    return F.concat(F.lit("[mock-answer] "), F.left(question, F.lit(200)))


def rerank_by_answers(ranked: DataFrame, answers: DataFrame, query_key: str = "query_id", key: str = "id") -> DataFrame:
    """ranked in the order of model answers (query_key, answer), a JSON array of {id, score}: rows by score, those the answer leaves out are dropped; a list whose answer cannot be read keeps its order."""
    parsed = answers.select(query_key, F.from_json("answer", "array<struct<id:string,score:double>>").alias("a"))
    given = parsed.select(query_key, F.explode("a").alias("x")).where("x.id is not null").select(query_key, F.col("x.id").alias(key), F.coalesce("x.score", F.lit(0.0)).alias("answered")).groupBy(query_key, key).agg(F.max("answered").alias("answered"))
    hit = ranked.join(given, [query_key, key])
    read = hit.select(query_key).distinct()
    kept = ranked.join(read, query_key, "left_anti").withColumn("answered", -F.col("rank").cast("double"))
    rows = hit.unionByName(kept).drop("rank")
    return top(rows, 1 << 20, "answered", query_key, key).drop("answered")


register("embedder", "hashed", hashed_embedder)
register("chat", "quoting", quoting_chat)
register("reranker", "answers", rerank_by_answers)
