"""Dense scoring: normalised vectors, block products with a bounded set of query vectors, inverted-file search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.functions.batches import flat_list
from quern.operators.lexical import small
from quern.plans.session import cut_lineage

#: Most query vectors that go to the tasks as one matrix; a larger set is worked off in blocks of that size.
QUERY_BLOCK = 4096


def usable(vector: Column, dim: int) -> Column:
    """Exactly `dim` finite numbers, not all zero."""
    return vector.isNotNull() & (F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)


def normalised(vector: Column) -> Column:
    """A vector divided by its length (1e-9 for length 0), in double."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.when(length > 0, length).otherwise(F.lit(1e-9)))


def latest_vectors(responses: DataFrame, model: str, dim: int, key: str = "chunk_id") -> DataFrame:
    """(key, embedding): the newest usable vector of each chunk from one model; ties go to the larger vec_id."""
    rows = responses.where((F.col("model") == model) & F.col(key).isNotNull() & usable(F.col("embedding"), dim))
    return rows.groupBy(key).agg(F.max_by("embedding", F.struct("created_at", "vec_id")).alias("embedding"))


def _cosines(batch: pa.RecordBatch, matrix: np.ndarray) -> np.ndarray:
    x = flat_list(batch.column("embedding"))[0].astype(np.float64).reshape(batch.num_rows, -1)
    length = np.linalg.norm(x, axis=1)
    return (x / np.where(length > 0, length, 1e-9)[:, None]) @ matrix.T


def _products(batches: Iterator[pa.RecordBatch], ids: list, kind: pa.DataType, matrix: np.ndarray, keep: int | None) -> Iterator[pa.RecordBatch]:
    asked = pa.array(ids, kind)
    for batch in batches:
        if not batch.num_rows:
            continue
        cos = _cosines(batch, matrix)
        if keep is not None and len(cos) > keep:  # more than any batch can contribute to a top list, ties included
            least = np.partition(cos, len(cos) - keep, axis=0)[len(cos) - keep]
            row, column = np.nonzero(cos >= least - 1e-9)
        else:
            row, column = np.divmod(np.arange(cos.size), len(ids))
        for i in range(0, len(row), 200_000):
            r, c = row[i : i + 200_000], column[i : i + 200_000]
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(c)), batch.column("key").take(pa.array(r)), pa.array(cos[r, c])], ["q", "key", "dense"])


def _sums(batches: Iterator[pa.RecordBatch], ids: list, kind: pa.DataType, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    n, s1, s2 = 0, np.zeros(len(ids)), np.zeros(len(ids))
    for batch in batches:
        if batch.num_rows:
            cos = _cosines(batch, matrix)
            n, s1, s2 = n + len(cos), s1 + cos.sum(axis=0), s2 + (cos * cos).sum(axis=0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(np.full(len(ids), n, np.int64)), pa.array(s1), pa.array(s2)], ["q", "n", "s1", "s2"])


def _matrix(queries: DataFrame, query_key: str) -> tuple[list, pa.DataType, np.ndarray]:
    """Keys and normalised vectors of the queries; bounded by QUERY_BLOCK."""
    asked = queries.select(query_key, "embedding").limit(QUERY_BLOCK + 1).collect()
    if len(asked) > QUERY_BLOCK:
        raise ValueError(f"at most {QUERY_BLOCK} query vectors at a time; split the queries")
    asked.sort(key=lambda r: r[0])
    m = np.array([r["embedding"] for r in asked], np.float64)
    if len(asked):
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    return [r[0] for r in asked], to_arrow_type(queries.schema[query_key].dataType), m


def dense_scores(queries: DataFrame, vectors: DataFrame, query_key: str = "query_id", key: str = "id", keep: int | None = None) -> DataFrame:
    """(query_key, key, dense): cosine of every query with every vector, worked out as block products in Arrow batches.

    With `keep` a batch gives only what can be among a query's `keep` best.
    Queries are bounded by QUERY_BLOCK rows a pass.
    """
    ids, kind, m = _matrix(queries, query_key)
    kinds = dict(queries.select(query_key).dtypes) | dict(vectors.select(key).dtypes)
    schema = f"q {kinds[query_key]}, key {kinds[key]}, dense double"
    rows = vectors.select(F.col(key).alias("key"), "embedding")
    rows = rows.mapInArrow(lambda it: _products(it, ids, kind, m, keep), schema) if ids else vectors.sparkSession.createDataFrame([], schema)
    return rows.select(F.col("q").alias(query_key), F.col("key").alias(key), "dense")


def dense_moments(queries: DataFrame, vectors: DataFrame, query_key: str = "query_id") -> DataFrame:
    """(query_key, mean, dev) of the cosines with all vectors: each task sends three sums a query, no pairs."""
    ids, kind, m = _matrix(queries, query_key)
    schema = f"q {dict(queries.dtypes)[query_key]}, n bigint, s1 double, s2 double"
    rows = vectors.select("embedding").mapInArrow(lambda it: _sums(it, ids, kind, m), schema) if ids else vectors.sparkSession.createDataFrame([], schema)
    g = rows.groupBy("q").agg((F.sum("s1") / F.sum("n")).alias("mean"), (F.sum("s2") / F.sum("n")).alias("square"))
    return g.select(F.col("q").alias(query_key), "mean", F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean"))).alias("dev"))


def _profile(batches: Iterator[pa.RecordBatch], ids: list, kind: pa.DataType, matrix: np.ndarray, keep: int) -> Iterator[pa.RecordBatch]:
    asked = pa.array(ids, kind)
    names = ["q", "key", "flag", "dense", "n", "s1", "s2"]
    n, s1, s2 = 0, np.zeros(len(ids)), np.zeros(len(ids))
    for batch in batches:
        if not batch.num_rows:
            continue
        cos = _cosines(batch, matrix)
        n, s1, s2 = n + len(cos), s1 + cos.sum(axis=0), s2 + (cos * cos).sum(axis=0)
        flags = batch.column("flag").to_numpy(zero_copy_only=False).astype(bool)
        for flag in (False, True):
            own = np.flatnonzero(flags == flag)
            if not len(own):
                continue
            part = cos[own]
            least = np.partition(part, len(part) - keep, axis=0)[len(part) - keep] if len(part) > keep else np.full(len(ids), -2.0)
            row, column = np.nonzero(part >= least - 1e-9)
            empty = pa.nulls(len(row), pa.float64())
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(column)), batch.column("key").take(pa.array(own[row])), pa.array(np.full(len(row), flag)), pa.array(part[row, column]), pa.nulls(len(row), pa.int64()), empty, empty], names)
        key = batch.column("key").type
    if n:
        yield pa.RecordBatch.from_arrays([asked, pa.nulls(len(ids), key), pa.nulls(len(ids), pa.bool_()), pa.nulls(len(ids), pa.float64()), pa.array(np.full(len(ids), n, np.int64)), pa.array(s1), pa.array(s2)], names)


def dense_profile(queries: DataFrame, vectors: DataFrame, keep: int, flag: Column | None = None, query_key: str = "query_id", key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The best vectors of each query and the moments over all of them, from one pass over the vectors.

    (query_key, key, flag, dense): at least the `keep` best of either value of
    `flag`, by batch; (query_key, n, mean, dev). The pass is written once;
    queries are bounded by QUERY_BLOCK.
    """
    ids, kind, m = _matrix(queries, query_key)
    kinds = dict(queries.select(query_key).dtypes) | dict(vectors.select(key).dtypes)
    schema = f"q {kinds[query_key]}, key {kinds[key]}, flag boolean, dense double, n bigint, s1 double, s2 double"
    rows = vectors.select(F.col(key).alias("key"), "embedding", F.coalesce(flag if flag is not None else F.lit(False), F.lit(False)).alias("flag"))
    rows = cut_lineage(rows.mapInArrow(lambda it: _profile(it, ids, kind, m, keep), schema)) if ids else vectors.sparkSession.createDataFrame([], schema)
    best = rows.where("n is null").select(F.col("q").alias(query_key), F.col("key").alias(key), "flag", "dense")
    g = rows.where("n is not null").groupBy("q").agg(F.sum("n").alias("n"), (F.sum("s1") / F.sum("n")).alias("mean"), (F.sum("s2") / F.sum("n")).alias("square"))
    return best, g.select(F.col("q").alias(query_key), "n", "mean", F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean"))).alias("dev"))


def dense_of(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, query_key: str = "query_id", key: str = "id") -> DataFrame:
    """(query_key, key, dense) of the given pairs alone."""
    asked = queries.select(query_key, normalised(F.col("embedding")).alias("_q"))
    rows = vectors.join(small(pairs.select(query_key, key), 1_000_000), key).join(small(asked, QUERY_BLOCK), query_key)
    return rows.select(query_key, key, F.aggregate(F.zip_with(normalised(F.col("embedding")), "_q", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x).alias("dense"))


def inverted_file(vectors: DataFrame, cells: int = 64, key: str = "id", seed: int = 42, sample: int = 20_000) -> tuple[DataFrame, np.ndarray]:
    """(key, embedding, cell) of every vector, and the centroids: fitted on a bounded sample, every vector is indexed."""
    part = vectors.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(sample).select("embedding").toArrow()
    x = flat_list(part.column("embedding"))[0].astype(np.float64).reshape(part.num_rows, -1)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    cells = min(cells, len(x))
    c = x[np.random.default_rng(seed).choice(len(x), cells, replace=False)]
    for _ in range(8):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.where(size > 0, size, 1), c)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = flat_list(batch.column("embedding"))[0].astype(np.float64).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.argmax(v @ c.T, axis=1).astype(np.int32))], [*batch.schema.names, "cell"])

    kind = dict(vectors.dtypes)
    return vectors.select(key, "embedding").mapInArrow(assign, f"`{key}` {kind[key]}, embedding {kind['embedding']}, cell int"), c


def search_cells(index: DataFrame, centroids: np.ndarray, queries: DataFrame, probes: int, k: int, query_key: str = "query_id", key: str = "id") -> DataFrame:
    """(query_key, key, dense, rank): the k best of the `probes` nearest cells of each query."""
    spark = index.sparkSession
    asked = queries.select(query_key, "embedding").limit(QUERY_BLOCK + 1).collect()
    if len(asked) > QUERY_BLOCK:
        raise ValueError(f"at most {QUERY_BLOCK} query vectors at a time; split the queries")
    kind = dict(queries.dtypes)[query_key]
    asked.sort(key=lambda r: r[0])
    m = np.array([r["embedding"] for r in asked], np.float64)
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) if len(asked) else np.zeros((0, centroids.shape[1]))
    near = np.argsort(-(m @ centroids.T), axis=1, kind="stable")[:, :probes]
    wanted = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
    ids = pa.array([r[0] for r in asked], to_arrow_type(queries.schema[query_key].dataType))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            for cell in np.unique(cells):
                rows, who = np.flatnonzero(cells == cell), wanted[int(cell)]
                cos = _cosines(batch.take(pa.array(rows)), m[who])
                least = np.partition(cos, len(cos) - k, axis=0)[len(cos) - k] if len(cos) > k else np.full(len(who), -2.0)
                r, c = np.nonzero(cos >= least - 1e-9)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(who[c])), batch.column("key").take(pa.array(rows[r])), pa.array(cos[r, c])], ["q", "key", "dense"])

    if not wanted:
        return spark.createDataFrame([], f"`{query_key}` {kind}, `{key}` {dict(index.dtypes)[key]}, dense double, rank int")
    found = index.where(F.col("cell").isin(*sorted(wanted))).select(F.col(key).alias("key"), "embedding", "cell").mapInArrow(products, f"q {kind}, key {dict(index.dtypes)[key]}, dense double")
    found = found.select(F.col("q").alias(query_key), F.col("key").alias(key), "dense")
    order = Window.partitionBy(query_key).orderBy(F.desc("dense"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query_key, key, "dense", "rank")
