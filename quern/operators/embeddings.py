"""The embedding cache: vectors by the hash of the text they were made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.dense import usable


def content_hash(text: Column, digits: int = 16) -> Column:
    """The first digits of a text's sha1: what a vector is stored under."""
    return F.left(F.sha1(text), F.lit(digits))


def cache(responses: DataFrame, model: str, dim: int) -> DataFrame:
    """(hash, vec_id, embedding, n): the newest usable vector of each content hash from one model, ties to the larger vec_id, and how many there are. Rows without a hash are left out."""
    rows = responses.where((F.col("model") == model) & F.col("hash").isNotNull() & usable(F.col("embedding"), dim))
    return rows.groupBy("hash").agg(F.max_by(F.struct("vec_id", "embedding"), F.struct("created_at", "vec_id")).alias("s"), F.count("*").alias("n")).select("hash", "s.vec_id", "s.embedding", "n")


def _contents(chunks: DataFrame) -> DataFrame:
    return chunks.where("text is not null").select("id", content_hash(F.col("text")).alias("hash")).distinct()


def lookup(chunks: DataFrame, cached: DataFrame) -> DataFrame:
    """(id, hash, vec_id, embedding) of every chunk (id, text); the last two are null where the cache has no vector of its content. Null texts are left out, repeated rows count once."""
    return _contents(chunks).join(cached.select("hash", "vec_id", "embedding"), "hash", "left").select("id", "hash", "vec_id", "embedding")


def misses(chunks: DataFrame, cached: DataFrame) -> DataFrame:
    """(hash) of contents that the cache has no vector of."""
    return _contents(chunks).select("hash").distinct().join(cached.select("hash"), "hash", "left_anti")


def stale(chunks: DataFrame, cached: DataFrame) -> DataFrame:
    """The rows of the cache whose content is in no chunk."""
    return cached.join(_contents(chunks).select("hash").distinct(), "hash", "left_anti")
