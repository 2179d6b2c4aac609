"""The most similar vectors for every vector, as a block matrix join of int8 tiles.

Vectors are normalised and sent to the `probes` nearest of a set of
centroids; vectors that share a cell form a block. A block's tile of int8
products bounds every cosine from both sides (the norms of the rounding
residuals bound the error), pairs that can still count are computed in
float, and each vector keeps its `k` best; the lists of its cells are merged.
The tile's whole numbers are multiplied as float32, where they are exact:
the matrix routines at hand have no int8 form.

The centroids are fitted on a bounded sample (SAMPLE vectors); where a model
has more than MOST_CELLS x CELL vectors every cell is divided further, by
centroids fitted on a bounded sample of that cell (PER_PART a part), so cells
grow in number with the vectors and not in size. Every vector is indexed and
every vector is a query. The members of every cell are counted, and cells
larger than BLOCK are cut into blocks that are joined two by two, so a task
never holds more than two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.batches import flat_list, list_column
from quern.plans.session import partitions_of

#: Vectors, over all models, from which centroids are fitted, and vectors of a cell for each part it is divided into.
SAMPLE, PER_PART = 20_000, 24
#: Vectors a cell should hold per centroid, the most centroids of a model at the first level, and the most parts of one cell.
CELL, MOST_CELLS, MOST_PARTS = 1600, 2048, 128
#: Cells of the first level whose parts are looked through for a vector.
LOOK = 8
#: Most rows of one side of a block.
BLOCK = 8192
TILE = 1024
#: Bytes of vectors a shuffle partition should hold.
PARTITION = 64 << 20


def usable_vectors(df: DataFrame, dims: dict[str, int], key: str = "vec_id", model: str = "model", vector: str = "embedding") -> DataFrame:
    """(vec_id, model, v): vectors with exactly their model's length, finite and not all zero, scaled to length 1. Others, null keys and unknown models are left out."""
    length = F.create_map(*(F.lit(x) for kv in dims.items() for x in kv))
    rows = df.select(F.col(key).cast("bigint").alias("vec_id"), F.col(model).alias("model"), F.col(vector).cast("array<float>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") == F.element_at(length, F.col("model"))))
    return rows.mapInArrow(_normal, "vec_id bigint, model string, v array<float>")


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, offsets = flat_list(batch.column("v"))
        size = np.diff(offsets)
        x = values.astype(np.float64)
        row = np.repeat(np.arange(len(size)), size)
        bad = np.bincount(row, weights=~np.isfinite(x), minlength=len(size)) > 0
        peak = np.zeros(len(size))
        np.maximum.at(peak, row, np.where(np.isfinite(x), np.abs(x), 0))
        x = x / np.where(peak > 0, peak, 1)[row]  # keeps squares of tiny and huge numbers in range
        norm = np.sqrt(np.bincount(row, weights=np.where(np.isfinite(x), x, 0) ** 2, minlength=len(size)))
        good = ~bad & (norm > 0)
        keep = good[row]
        mask = pa.array(good)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(mask), batch.column("model").filter(mask), list_column((x[keep] / norm[row[keep]]).astype(np.float32), size[good], pa.float32())], ["vec_id", "model", "v"])


def _centroids(x: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of unit vectors by five rounds of spherical k-means from a fixed seed."""
    c = x[np.random.default_rng(11).choice(len(x), cells, replace=False)]
    for _ in range(5):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.where(size > 0, size, 1), c).astype(np.float32)
    return c


def _fit(vectors: DataFrame) -> tuple[dict[str, np.ndarray], dict[str, int]]:
    """Per model the centroids as cells x parts x numbers, and the number of vectors."""
    counts = {r["model"]: r["n"] for r in vectors.groupBy("model").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return {}, {}
    draw = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 20))
    part = max(1, min(1 << 20, int((1 << 20) * 0.9 * SAMPLE / total)))
    kept = vectors.where(draw < part).limit(SAMPLE).toPandas().sort_values("vec_id")
    fitted: dict[str, np.ndarray] = {}
    for model, n in counts.items():
        own = kept[kept.model == model]
        if not len(own):
            own = vectors.where(F.col("model") == model).limit(1).toPandas()
        x = np.stack(own.v.to_list()).astype(np.float32)
        fitted[model] = _centroids(x, int(np.clip(n // CELL, 1, min(MOST_CELLS, len(x)))))[:, None, :]
        parts = int(min(MOST_PARTS, -(-(n // CELL) // len(fitted[model]))))
        if parts > 1:
            rows = vectors.where((F.col("model") == model) & (F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(1 << 20)) < int(np.ceil((1 << 20) * min(1.0, 2 * PER_PART / CELL)))))
            fitted[model] = _divided(rows, model, fitted[model], parts)
    return fitted, counts


def _divided(rows: DataFrame, model: str, c: np.ndarray, parts: int) -> np.ndarray:
    """The cells of a model, each divided into parts by centroids fitted, cell by cell in tasks, on at most PER_PART x parts of its sampled vectors; a cell with fewer keeps its own centroid in place of the missing."""
    def fit(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        x = flat_list(table.column("v"))[0].reshape(len(ids), -1)[np.argsort(ids)][: PER_PART * parts]
        own = _centroids(x, min(parts, len(x)))
        return pa.table({"cell": pa.array(np.full(len(own), table.column("cell")[0].as_py()), pa.int32()), "c": list_column(own.ravel(), np.full(len(own), own.shape[1]), pa.float32())})

    placed = rows.mapInArrow(lambda it: _assign(it, {model: c}, {}, 1), ASSIGNED)
    out = np.repeat(c, parts, axis=1)
    found = placed.groupBy("cell").applyInArrow(fit, "cell int, c array<float>").orderBy("cell").collect()  # at most MOST_CELLS x MOST_PARTS rows
    seen: dict[int, int] = {}
    for r in found:
        at = seen.get(r["cell"], 0)
        out[r["cell"], at] = r["c"]
        seen[r["cell"]] = at + 1
    return out


def _nearest(x: np.ndarray, c: np.ndarray, probes: int) -> np.ndarray:
    """For each vector the numbers (cell x parts + part) of its nearest parts; parts are sought in the LOOK nearest cells."""
    cells, parts, width = c.shape
    if parts == 1:
        p = min(probes, cells)
        return np.argpartition(-(x @ c[:, 0].T), p - 1, axis=1)[:, :p]
    middle = c.mean(axis=1)
    look = min(LOOK, cells)
    p = min(probes, look * parts)
    out = np.empty((len(x), p), np.int64)
    for i in range(0, len(x), 256):
        own = x[i : i + 256]
        near = np.argpartition(-(own @ middle.T), look - 1, axis=1)[:, :look]
        score = np.einsum("rd,rlpd->rlp", own, c[near]).reshape(len(own), -1)
        best = np.argpartition(-score, p - 1, axis=1)[:, :p]
        out[i : i + 256] = near[np.arange(len(own))[:, None], best // parts] * parts + best % parts
    return out


ASSIGNED = "m int, cell int, low int, high int, mine int, vec_id bigint, v array<float>"


def _assign(batches: Iterator[pa.RecordBatch], fitted: dict[str, np.ndarray], blocks: dict[str, np.ndarray], probes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for m, rows, ids, x in _by_model(batch, fitted):
            name = list(fitted)[m]
            cells = _nearest(x, fitted[name], probes)
            who, cell = np.repeat(np.arange(len(rows)), cells.shape[1]), cells.ravel()
            many = blocks[name][cell] if name in blocks else np.ones(len(cell), np.int64)
            mine = np.abs(ids[who] * 2654435761 >> 7) % many
            again = np.repeat(np.arange(len(who)), many)
            other = np.arange(len(again)) - np.repeat(np.cumsum(many) - many, many)
            who, cell, mine = who[again], cell[again], mine[again]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(who), m, np.int32)), pa.array(cell.astype(np.int32)), pa.array(np.minimum(mine, other).astype(np.int32)), pa.array(np.maximum(mine, other).astype(np.int32)), pa.array(mine.astype(np.int32)), pa.array(ids[who]), list_column(x[who].ravel(), np.full(len(who), x.shape[1]), pa.float32())],
                ["m", "cell", "low", "high", "mine", "vec_id", "v"],
            )


def _by_model(batch: pa.RecordBatch, fitted: dict[str, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    names = batch.column("model").to_numpy(zero_copy_only=False)
    values, offsets = flat_list(batch.column("v"))
    ids = batch.column("vec_id").to_numpy()
    for m, (name, c) in enumerate(fitted.items()):
        rows = np.flatnonzero(names == name)
        if len(rows):
            yield m, rows, ids[rows], values[(offsets[rows][:, None] + np.arange(c.shape[2])).ravel()].reshape(len(rows), -1)


def _members(batches: Iterator[pa.RecordBatch], fitted: dict[str, np.ndarray], probes: int) -> Iterator[pa.RecordBatch]:
    """Members of the cells, a row for each cell a task met."""
    held = [np.zeros(c.shape[0] * c.shape[1], np.int64) for c in fitted.values()]
    for batch in batches:
        for m, _, _, x in _by_model(batch, fitted):
            held[m] += np.bincount(_nearest(x, fitted[list(fitted)[m]], probes).ravel(), minlength=len(held[m]))
    for m, n in enumerate(held):
        cell = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), m, np.int32)), pa.array(cell.astype(np.int32)), pa.array(n[cell])], ["m", "cell", "n"])


def _int8(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Rounded to int8 range, the step, and the largest residual norm."""
    step = float(np.abs(x).max()) / 127 or 1.0
    q = np.rint(x / step)
    return q.astype(np.float32), step, float(np.linalg.norm(x - q * step, axis=1).max())


def block_best(x: np.ndarray, y: np.ndarray, ids_x: np.ndarray, ids_y: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of x its k best rows of y with cosine >= floor: (a, b, cosine)."""
    qx, sx, ex = _int8(x)
    qy, sy, ey = _int8(y)
    slack = ex + (1 + ex) * ey + 1e-6  # |x.y - sx sy qx.qy| <= |x - sx qx| |y| + |sx qx| |y - sy qy|
    out: list[tuple[np.ndarray, ...]] = []
    for i in range(0, len(x), TILE):
        tile = qx[i : i + TILE] @ qy.T  # whole numbers below 2^24: exact in float32
        least = np.full(len(tile), floor)
        if floor <= -1 and len(y) > k + 1:  # no floor: what surely beats the row's (k+1)-th lower bound (itself may be among them)
            least = np.partition(tile, len(y) - k - 1, axis=1)[:, len(y) - k - 1] * (sx * sy) - slack
        r, c = np.nonzero(tile >= ((least - slack) / (sx * sy)).astype(np.float32)[:, None])
        keep = ids_x[i + r] != ids_y[c]
        r, c = r[keep], c[keep]
        cos = np.einsum("ij,ij->i", x[i + r].astype(np.float64), y[c].astype(np.float64)) if len(r) else np.zeros(0)
        keep = cos >= floor - 1e-9
        r, c, cos = r[keep], c[keep], cos[keep]
        order = np.lexsort((ids_y[c], -cos, r))
        r, c, cos = r[order], c[order], cos[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        best = rank < k
        out.append((ids_x[i + r[best]], ids_y[c[best]], cos[best]))
    return tuple(np.concatenate(z) for z in zip(*out))  # type: ignore[return-value]


def _join_block(table: pa.Table, k: int, floor: float) -> pa.Table:
    ids = table.column("vec_id").to_numpy()
    mine, low, high = table.column("mine").to_numpy(), table.column("low")[0].as_py(), table.column("high")[0].as_py()
    x = flat_list(table.column("v"))[0].reshape(len(ids), -1)
    order = np.lexsort((x[:, 0], ids))  # of rows that repeat an id always the same one
    ids, mine, x = ids[order], mine[order], x[order]
    _, once = np.unique(ids, return_index=True)
    ids, mine, x = ids[once], mine[once], x[once]
    if low == high:
        a, b, cos = block_best(x, x, ids, ids, k, floor)
    else:
        left, right = mine == low, mine == high
        both = [block_best(x[p], x[q], ids[p], ids[q], k, floor) for p, q in ((left, right), (right, left)) if p.any() and q.any()]
        a, b, cos = (np.concatenate(z) for z in zip(*both)) if both else (ids[:0], ids[:0], np.zeros(0))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "cosine": pa.array(cos, pa.float64())})


def most_similar(df: DataFrame, dims: dict[str, int], k: int = 5, floor: float = -1.0, probes: int = 3, key: str = "vec_id", model: str = "model", vector: str = "embedding") -> DataFrame:
    """(a, b, cosine, rank): for every usable vector a its k most similar vectors b of the same model with cosine >= floor, rank from 1.

    Ties go to the smaller id. Rows that repeat an id count once (their
    vectors are taken to be the same), a vector is not its own neighbour.
    Unusable vectors (see `usable_vectors`) and an empty table give no rows.
    Other columns are ignored. Neighbours are missed only where two vectors
    share none of their `probes` nearest cells.
    """
    vectors = usable_vectors(df, dims, key, model, vector)
    fitted, counts = _fit(vectors)
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    if not fitted:
        return vectors.select(F.col("vec_id").alias("a"), F.col("vec_id").alias("b"), F.lit(0.0).alias("cosine"), F.lit(1).alias("rank")).limit(0)
    blocks = {name: np.ones(c.shape[0] * c.shape[1], np.int64) for name, c in fitted.items()}
    names = list(fitted)
    for r in vectors.mapInArrow(lambda it: _members(it, fitted, probes), "m int, cell int, n bigint").groupBy("m", "cell").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK).collect():
        blocks[names[r["m"]]][r["cell"]] = -(-r["n"] // BLOCK)
    size = sum(counts[name] * probes * fitted[name].shape[2] * 4 for name in names)
    wide = max(partitions_of(df.sparkSession), size // PARTITION)
    cells = vectors.mapInArrow(lambda it: _assign(it, fitted, blocks, probes), ASSIGNED).repartition(int(wide), "m", "cell", "low", "high")
    found = cells.groupBy("m", "cell", "low", "high").applyInArrow(lambda t: _join_block(t, k, floor), "a bigint, b bigint, cosine double")
    return found.groupBy("a", "b").agg(F.max("cosine").alias("cosine")).repartition("a").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
