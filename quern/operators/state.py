"""State machines over ordered requests: sliding-window limiter, expiring cache, circuit breaker.

Each key's requests are folded in time order. In a batch the fold runs per
key over its rows sorted by Spark (secondary sort, rows streamed through the
task in Arrow batches), so a key is never held whole; the same step functions
serve the streaming operators in quern.streaming.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def limiter(most: int, window_us: int) -> Callable[[deque, int], bool]:
    """Step of a limiter: at most `most` accepted requests within the window; refused ones leave no trace."""

    def step(accepted: deque, ts: int) -> bool:
        while accepted and accepted[0] < ts - window_us:
            accepted.popleft()
        if len(accepted) >= most:
            return False
        accepted.append(ts)
        return True

    return step


class Cache:
    """Least recently used entries up to `size`, each for `ttl_us` after it was put; a hit refreshes its place, not its time."""

    def __init__(self, size: int, ttl_us: int) -> None:
        self.size, self.ttl, self.entries = size, ttl_us, OrderedDict()

    def ask(self, key: str, ts: int) -> str:
        put = self.entries.get(key)
        if put is not None and ts - put <= self.ttl:
            self.entries.move_to_end(key)
            return "hit"
        expired = self.entries.pop(key, None) is not None
        self.entries[key] = ts
        if len(self.entries) > self.size:
            self.entries.popitem(last=False)
            return "miss_evict"
        return "expired" if expired else "miss"


class Breaker:
    """closed, open after `threshold` failures in balance, half_open after `reset_us`, closed again by one success."""

    def __init__(self, threshold: int, reset_us: int) -> None:
        self.threshold, self.reset, self.failures, self.state, self.since = threshold, reset_us, 0, "closed", 0

    def report(self, ts: int, ok: bool) -> str:
        if self.state == "open":
            if ts - self.since < self.reset:
                return "open"
            self.state = "half_open"
        if ok:
            self.failures = 0 if self.state == "half_open" else max(0, self.failures - 1)
            self.state = "closed"
        else:
            self.failures += 1
            if self.state == "half_open" or self.failures >= self.threshold:
                self.state, self.since = "open", ts
        return self.state


def _fold(rows: DataFrame, key: str, time: str, order: list[str], start: Callable[[], object], step: Callable[[object, dict], object], out: str, kind: str, columns: list[str]) -> DataFrame:
    types = dict(rows.dtypes)
    sorted_rows = rows.withColumn("_us", F.unix_micros(F.col(time).cast("timestamp"))).repartition(F.col(key)).sortWithinPartitions(key, "_us", *order)
    arrow_type = {"boolean": pa.bool_(), "string": pa.string()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            answers = []
            for r in batch.to_pylist():
                if state is None or r[key] != last:
                    last, state = r[key], start()
                answers.append(step(state, r))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(answers, arrow_type)], [*columns, out])

    schema = ", ".join(f"`{c}` {types[c]}" for c in columns) + f", `{out}` {kind}"
    need = list(dict.fromkeys([key, *order, *columns]))
    return sorted_rows.select(*need, "_us").mapInArrow(run, schema)


def rate_limit(rows: DataFrame, key: str, time: str, order: list[str], columns: list[str], most: int = 10, seconds: float = 60.0) -> DataFrame:
    """columns with `allowed`: a sliding-window limiter per key over its requests in time order, ties by `order`. Null times are left out, null keys form one group."""
    step = limiter(most, int(seconds * 1e6))
    return _fold(rows.where(F.col(time).isNotNull()), key, time, order, deque, lambda s, r: step(s, r["_us"]), "allowed", "boolean", columns)


def cache_outcomes(rows: DataFrame, key: str, entry: str, time: str, order: list[str], columns: list[str], size: int = 100, ttl_seconds: float = 3600.0) -> DataFrame:
    """columns with `outcome` (hit, miss, expired, miss_evict): one cache per value of `key` asked for `entry` in time order."""
    return _fold(rows.where(F.col(time).isNotNull() & F.col(entry).isNotNull()), key, time, [*order, entry], lambda: Cache(size, int(ttl_seconds * 1e6)), lambda s, r: s.ask(r[entry], r["_us"]), "outcome", "string", columns)


def breaker_states(rows: DataFrame, key: str, ok: str, time: str, order: list[str], columns: list[str], threshold: int = 5, reset_seconds: float = 60.0) -> DataFrame:
    """columns with `state`: one circuit breaker per value of `key`; a null outcome counts as a failure."""
    return _fold(rows.where(F.col(time).isNotNull()), key, time, [*order, ok], lambda: Breaker(threshold, int(reset_seconds * 1e6)), lambda s, r: s.report(r["_us"], bool(r[ok])), "state", "string", columns)
