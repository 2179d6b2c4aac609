"""Filling fixed-capacity containers with items of varying length.

The histogram of lengths (at most `capacity` numbers, whatever the data) goes
to the driver. There a configuration linear program (containers by the counts
of lengths they hold) is solved by multiplicative weights: each round prices
the lengths, a knapsack dynamic program finds the best configuration at those
prices, and the lengths it serves lose weight. The solution is rounded; what
is left, a few items per configuration, goes to the fullest container it
fits. The plan says for each length which ordinals go where, and every item
finds its container from its ordinal alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.sizes import ordinals, token_count
from quern.plans.session import cut_lineage

#: Steps of the multiplicative weights, smaller from phase to phase; share of the lower bound within which a solution is good enough; most steps of a phase, and most knapsacks.
PHASES, GAP, STEPS, ROUNDS = (0.3, 0.1, 0.03), 0.002, 4_000, 240


def knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Counts per length of the most valuable filling of `capacity` (any number of each)."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    reach = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        options = best[c - lengths[: reach[c]]] + values[: reach[c]]
        k = int(options.argmax())
        if options[k] >= best[c - 1]:
            best[c], pick[c] = options[k], k
        else:
            best[c] = best[c - 1]
    counts = np.zeros(len(lengths), np.int64)
    c = capacity
    while c >= lengths[0]:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= int(lengths[pick[c]])
    return counts


def configurations(lengths: np.ndarray, numbers: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[np.ndarray, float]], float]:
    """A fractional solution of the configuration program, (counts per length, containers), and a lower bound of the containers of any packing.

    Every length has a price. A step takes a configuration that is nearly the
    best at these prices, as much of it as serves one of its lengths once,
    and lowers the prices of the lengths it serves. The best is found by a
    knapsack over the prices; while a configuration found before is good
    enough, no new one is sought. By duality the prices of all items over the
    value of the best configuration bound the containers from below; steps
    end within GAP of that bound, or after STEPS of them or `rounds` knapsacks.
    """
    need = numbers.astype(float)
    price = lengths / float((lengths * need).sum())
    pool = np.zeros((0, len(lengths)))
    known: dict[bytes, int] = {}
    bound, most, asked = float(need @ lengths) / capacity, 0.0, 0
    value, amounts = np.inf, np.zeros(0)
    for size in PHASES:  # the first steps are poor ones: each phase starts its amounts anew, at the prices reached
        used, covered, mean = np.zeros(len(pool)), np.zeros(len(lengths)), np.zeros(len(lengths))
        for step in range(STEPS):
            worth = pool @ price
            pick = int(worth.argmax()) if len(worth) else -1
            if pick < 0 or worth[pick] < (1 - size) * most:
                if asked >= rounds:
                    break
                asked += 1
                counts = knapsack(price, lengths, capacity)
                most = float(counts @ price)
                bound = max(bound, float(price @ need) / most)
                counts = np.minimum(counts, numbers)
                pick = known.setdefault(counts.tobytes(), len(pool))
                if pick == len(pool):
                    pool, used = np.vstack([pool, counts]), np.append(used, 0.0)
            own = pool[pick] > 0
            amount = float((need[own] / pool[pick][own]).min())
            used[pick] += amount
            gain = amount * pool[pick] / need
            covered += gain
            mean += price / float(price @ need)
            price = price * np.exp(-size * gain)
            if step % 20 == 0 and covered.min() > 0 and used.sum() / covered.min() < value:
                value, amounts = float(used.sum() / covered.min()), used / covered.min()
                if value <= (1 + GAP) * bound:
                    break
        bound = max(bound, float(mean @ need) / float(knapsack(mean, lengths, capacity) @ mean))
        price, most = price / price.max(), 0.0
        if asked >= rounds or value <= (1 + GAP) * bound:
            break
    if not np.isfinite(value):  # not every length was served: what was found, no length more often than it is there
        amounts = used / max(1.0, float(covered.max(initial=0.0)))
    return [(pool[i].astype(np.int64), float(x)) for i, x in enumerate(amounts) if x > 0], bound


def plan(lengths: np.ndarray, numbers: np.ndarray, capacity: int) -> tuple[dict[str, np.ndarray], int, float]:
    """Where the items of each length go: rows (length, first, last, each, container, start), the number of containers, and the program's lower bound of it.

    Ordinals first..last-1 of a length go `each` to a container, from `container` on, one behind the other from `start`.
    The program's solution is rounded down, then configurations are used once more, largest fractions first, while all
    they hold is left; the rest is filled up greedily. Where that takes more containers than filling greedily from the start, the latter stands.
    """
    solution, bound = configurations(lengths, numbers, capacity)
    table, containers = min((_placed(lengths, numbers, capacity, x) for x in (solution, [])), key=lambda t: t[1])
    return table, containers, bound


def _placed(lengths: np.ndarray, numbers: np.ndarray, capacity: int, solution: list[tuple[np.ndarray, float]]) -> tuple[dict[str, np.ndarray], int]:
    left = numbers.astype(np.int64).copy()
    rows: list[tuple[int, int, int, int, int, int]] = []
    containers = 0

    def place(counts: np.ndarray, times: int) -> None:
        nonlocal containers
        start = 0
        for k in np.flatnonzero(counts)[::-1]:
            first = int(numbers[k] - left[k])
            each = int(counts[k])
            rows.append((int(lengths[k]), first, first + each * times, each, containers, start))
            left[k] -= each * times
            start += each * int(lengths[k])
        containers += times

    for counts, amount in sorted(solution, key=lambda x: -int((x[0] * lengths).sum())):
        own = counts > 0
        times = int(min(np.floor(amount + 1e-9), (left[own] // counts[own]).min()))
        if times > 0:
            place(counts, times)
    for counts, _ in sorted(solution, key=lambda x: -(x[1] % 1)):
        if (left >= counts).all():
            place(counts, 1)
    # the rest: fill a container with the longest that fit, and repeat it as often as the counts allow
    while left.sum():
        counts = np.zeros(len(lengths), np.int64)
        room = capacity
        while room >= lengths[0]:
            fits = np.flatnonzero((left - counts > 0) & (lengths <= room))
            if not len(fits):
                break
            k = fits[-1]
            take = int(min(left[k] - counts[k], room // lengths[k], 1 if room == capacity or counts[k] else room // lengths[k]))
            counts[k] += max(1, take)
            room -= max(1, take) * int(lengths[k])
        own = counts > 0
        place(counts, int((left[own] // counts[own]).min()))
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    return {n: table[:, i] for i, n in enumerate(("length", "first", "last", "each", "container", "start"))}, containers


def _assign(batches: Iterator[pa.RecordBatch], table: dict[str, np.ndarray], zero: int) -> Iterator[pa.RecordBatch]:
    big = np.int64(1) << np.int64(44)
    keys = table["length"] * big + table["first"]
    for batch in batches:
        length, ordinal = batch.column("tokens").to_numpy(), batch.column("ordinal").to_numpy()
        if len(keys):
            at = np.maximum(np.searchsorted(keys, length * big + ordinal, side="right") - 1, 0)
            inside = ordinal - table["first"][at]
            each = table["each"][at]
            container = table["container"][at] + inside // each
            start = table["start"][at] + inside % each * length
        else:
            container, start = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        empty = length == 0
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("piece"), batch.column("pieces"), pa.array(length), pa.array(np.where(empty, zero, container)), pa.array(np.where(empty, 0, start))], ["id", "piece", "pieces", "tokens", "container", "start"])


def fill_containers(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048) -> DataFrame:
    """(key, piece, pieces, tokens, container, start): where each document goes.

    A document of more than `capacity` tokens, and no other, is cut: into
    pieces of `capacity` tokens and one with the rest. No container holds more
    than `capacity` tokens and `start` is a piece's place in it. Documents
    without tokens (null or blank text) take no room and go to container 0.
    Rows that repeat a key are items of their own; null keys are kept; other
    columns are ignored; an empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    sized = df.select(F.col(key).alias("id"), token_count(F.col(text)).alias("size"))
    sized = cut_lineage(sized)  # the texts are read and counted once
    number = F.greatest(F.ceil(F.col("size") / F.lit(capacity)), F.lit(1)).cast("int")
    pieces = sized.select("id", "size", number.alias("pieces"), F.explode(F.sequence(F.lit(0), number - 1)).alias("piece"))
    pieces = pieces.select("id", "piece", "pieces", F.when(F.col("piece") < F.col("pieces") - 1, F.lit(capacity)).otherwise(F.col("size") - F.lit(capacity) * (F.col("pieces") - 1)).cast("bigint").alias("tokens"))
    pieces = pieces.withColumn("order", F.xxhash64("id", "piece"))
    counts = {r["tokens"]: r["n"] for r in pieces.where("tokens > 0").groupBy("tokens").agg(F.count("*").alias("n")).collect()}
    lengths = np.array(sorted(counts), np.int64)
    numbers = np.array([counts[x] for x in lengths.tolist()], np.int64)
    empty = {n: np.zeros(0, np.int64) for n in ("length", "first", "last", "each", "container", "start")}
    table = plan(lengths, numbers, capacity)[0] if len(lengths) else empty
    kind = sized.schema["id"].dataType.simpleString()
    placed = ordinals(pieces, ["tokens"], "order").mapInArrow(lambda it: _assign(it, table, 0), f"id {kind}, piece int, pieces int, tokens bigint, container bigint, start bigint")
    return placed.withColumnRenamed("id", key)


def cut_documents(placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The keys of the documents that were cut: their pieces went to more than one place."""
    places = placed.where("pieces > 1").groupBy(key).agg(F.count_distinct("container", "start").alias("places"))
    return places.where("places > 1").select(key)
