"""Streaming forms of the state operators and of windowed metrics."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.operators.metrics import windowed_counts
from quern.operators.state import Breaker, limiter


def limit_stream(rows: DataFrame, key: str, time: str, order: str, most: int = 10, seconds: float = 60.0) -> DataFrame:
    """(key, order, allowed) of a stream of requests: the limiter of quern.operators.state, its accepted times kept per key.

    Within a micro-batch a key's rows are taken in time order, so batches that
    arrive in order give what the batch operator gives. State holds at most
    `most` times a key; those out of the window go with the key's next request.
    """
    kinds = dict(rows.dtypes)
    step = limiter(most, int(seconds * 1e6))

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        accepted = deque(state.get[0]) if state.exists else deque()
        pdf = pd.concat(list(batches)).sort_values(["us", order], kind="stable")
        allowed = [step(accepted, int(ts)) for ts in pdf.us]
        state.update((list(accepted),))
        yield pd.DataFrame({key: keys[0], order: pdf[order], "allowed": allowed})

    timed = rows.where(F.col(time).isNotNull()).select(key, order, F.unix_micros(F.col(time).cast("timestamp")).alias("us"))
    return timed.groupBy(key).applyInPandasWithState(run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, allowed boolean", "accepted array<bigint>", "append", GroupStateTimeout.NoTimeout)


def breaker_stream(rows: DataFrame, key: str, ok: str, time: str, order: str, threshold: int = 5, reset_seconds: float = 60.0) -> DataFrame:
    """(key, order, state) of a stream of outcomes: one circuit breaker a key."""
    kinds = dict(rows.dtypes)

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        breaker = Breaker(threshold, int(reset_seconds * 1e6))
        if state.exists:
            breaker.failures, breaker.state, breaker.since = state.get
        pdf = pd.concat(list(batches)).sort_values(["us", order], kind="stable")
        states = [breaker.report(int(r.us), bool(r.ok)) for r in pdf.itertuples()]
        state.update((breaker.failures, breaker.state, breaker.since))
        yield pd.DataFrame({key: keys[0], order: pdf[order], "state": states})

    timed = rows.where(F.col(time).isNotNull()).select(key, order, F.col(ok).alias("ok"), F.unix_micros(F.col(time).cast("timestamp")).alias("us"))
    return timed.groupBy(key).applyInPandasWithState(run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, state string", "failures int, state string, since bigint", "append", GroupStateTimeout.NoTimeout)


__all__ = ["breaker_stream", "limit_stream", "windowed_counts"]
