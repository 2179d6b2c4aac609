"""Mixing sources to target weights, measured in tokens.

Each listed source gets a budget: its weight times the tokens of all listed
sources. It is used whole as often as the budget allows (at most
`max_repeats` times); the rest of the budget is met by a subset. Documents
are counted by exact token length; the same share of every length is taken,
rounded down, and what then remains, a bounded number of tokens, is fitted by
a bounded-knapsack dynamic program over the lengths still free. Within a
length the documents are chosen by a seeded hash.

Lengths up to LONG are counted one by one. Documents longer than that have
few equals, so a source's are put in the order of a seeded hash and taken as
far as their share of the budget goes; those around that point, up to NEAR on
either side, go into the dynamic program with their exact lengths.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.sizes import ordinals, running, token_count
from quern.plans.session import cut_lineage

#: Lengths up to this are counted exactly, whatever the number of documents.
LONG = 8192
#: Long documents of a source on either side of its share of the budget that the dynamic program may take or leave.
NEAR = 64
#: Largest rest that the dynamic program fits exactly, and the table entries it may look at; larger rests are first brought under it with the longest lengths.
FIT, WORK = 1 << 16, 1 << 28
#: Most (source, length) counts that are collected, and most rows of a table that is broadcast.
MOST_COUNTS, BROADCAST_ROWS = 4_000_000, 200_000


def subset_counts(lengths: np.ndarray, free: np.ndarray, target: int) -> np.ndarray:
    """How many of each length to take, at most free, so that the sum comes as close to target from below as it can."""
    taken = np.zeros(len(lengths), np.int64)
    rest = int(target)
    fit = int(max(FIT, min(1 << 24, WORK // max(1, int(np.log2(free + 1).sum()) + len(free)))))
    for k in range(len(lengths) - 1, -1, -1):
        if rest <= fit:
            break
        n = int(min(free[k], (rest - fit // 2) // lengths[k]))
        if n > 0:
            taken[k] += n
            rest -= n * int(lengths[k])
    rest = min(rest, fit)
    if rest <= 0:
        return taken
    reach = np.zeros(rest + 1, bool)
    reach[0] = True
    parts: list[tuple[int, int, np.ndarray]] = []
    for k in range(len(lengths)):
        n, unit = int(min(free[k] - taken[k], rest // lengths[k])), 1
        while n > 0:  # counts in binary parts: 1, 2, 4, ... of one length
            step = min(unit, n)
            size = step * int(lengths[k])
            new = np.zeros_like(reach)
            new[size:] = reach[: rest + 1 - size]
            new &= ~reach
            if new.any():
                parts.append((k, step, np.flatnonzero(new)))
                reach |= new
            n -= step
            unit *= 2
        if reach[rest]:
            break
    at = int(np.flatnonzero(reach)[-1])
    for k, step, first in reversed(parts):
        i = np.searchsorted(first, at)
        if i < len(first) and first[i] == at:  # this sum was first reached with this part
            taken[k] += step
            at -= step * int(lengths[k])
    return taken


def _measured(df: DataFrame, targets: DataFrame, key: str, text: str, source: str) -> tuple[DataFrame, list[dict]]:
    listed = [r.asDict() for r in targets.select(F.col("source").alias("name"), F.lower(F.trim(F.regexp_replace("source", r"(?U)^\s+|\s+$", ""))).alias("source"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("max_repeats", F.lit(1)).alias("most")).limit(100_001).collect()]
    if len(listed) > 100_000:
        raise ValueError("mix targets are meant to be a short list")
    sized = df.select(F.col(key).alias("id"), F.lower(F.regexp_replace(F.col(source), r"(?U)^\s+|\s+$", "")).alias("source"), token_count(F.col(text)).alias("tokens"))
    names = sorted({r["source"] for r in listed if r["source"] is not None})
    sized = sized.where(F.col("source").isin(names) if names else F.lit(False))
    sized = cut_lineage(sized)  # the texts are read and counted once
    own = {r["source"]: (r["t"], r["n"]) for r in sized.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}
    total = sum(t for t, _ in own.values())
    for r in listed:
        r["own"] = own.get(r["source"], (0, 0))[0]
        r["documents"] = own.get(r["source"], (0, 0))[1]
        r["most"] = max(0, int(r["most"]))
        r["asked"] = float(r["weight"]) * total
        r["short"] = r["asked"] > r["most"] * r["own"]
    return sized, listed


def _budgets(df: DataFrame, listed: list[dict]) -> DataFrame:
    rows = [(r["name"], float(r["weight"]), r["most"], r["documents"], int(r["own"]), float(r["asked"]), bool(r["short"])) for r in listed]
    return df.sparkSession.createDataFrame(rows, "source string, weight double, max_repeats int, documents bigint, own_tokens bigint, target_tokens double, short boolean")


def mix(df: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """(key, source, tokens, copies): the documents of the mixture and how often each is used, source trimmed and in lower case.

    A source listed more than once (after trimming) keeps its first target.
    Documents without tokens come as often as their source is used whole.
    Rows that repeat a key are documents of their own. Other columns are
    ignored; empty tables give no rows.
    """
    return _mixed(*_measured(df, targets, key, text, source), seed).withColumnRenamed("id", key)


def _mixed(sized: DataFrame, listed: list[dict], seed: int) -> DataFrame:
    spark = sized.sparkSession
    first: dict[str, dict] = {}
    for r in listed:
        if r["source"] is not None:
            first.setdefault(r["source"], r)
    kind = sized.schema["id"].dataType.simpleString()
    schema = f"id {kind}, source string, tokens bigint, copies int"
    if not first:
        return spark.createDataFrame([], schema)
    for r in first.values():
        r["whole"] = r["most"] if r["short"] else int(min(r["most"], r["asked"] // r["own"])) if r["own"] else 0
        r["rest"] = 0 if r["short"] or r["whole"] >= r["most"] or not r["own"] else round(r["asked"] - r["whole"] * r["own"])
    short = sized.where((F.col("tokens") > 0) & (F.col("tokens") <= LONG)).groupBy("source", "tokens").agg(F.count("*").alias("n"))
    hist: dict[str, dict[int, int]] = {}
    for r in _bounded(short, MOST_COUNTS):
        hist.setdefault(r["source"], {})[r["tokens"]] = r["n"]
    long = running(sized.where(F.col("tokens") > LONG).withColumn("order", F.xxhash64("id", F.lit(seed))), "source", "tokens", "order")
    goal = F.element_at(F.create_map(*(F.lit(x) for name, r in first.items() for x in (name, float(r["rest"] / r["own"] if r["own"] else 0.0)))), F.col("source"))
    long = cut_lineage(long)
    totals = long.groupBy("source").agg(F.sum("tokens").alias("total"))
    reach = long.join(F.broadcast(totals), "source").groupBy("source").agg(F.count_if(F.col("sum") <= goal * F.col("total")).alias("m"))
    reach = {r["source"]: r["m"] for r in reach.collect()}
    near: dict[str, list] = {}
    sums: dict[str, int] = {}
    if reach:
        middle = F.element_at(F.create_map(*(F.lit(x) for name, m in reach.items() for x in (name, m))), F.col("source"))
        for r in _bounded(long.where((F.col("place") >= middle - NEAR) & (F.col("place") < middle + NEAR)).select("source", "place", "tokens", "sum"), MOST_COUNTS):
            near.setdefault(r["source"], []).append((r["place"], r["tokens"], r["sum"]))
    counts, picked = [], []
    for name, r in first.items():
        around = sorted(near.get(name, []))
        sums[name] = around[0][2] - around[0][1] if around else 0  # tokens of the documents before them, all taken
        lengths = np.array(sorted(hist.get(name, {})), np.int64)
        free = np.array([hist[name][x] for x in lengths.tolist()], np.int64)
        left = r["rest"] - sums[name]
        if r["rest"] <= 0:
            picked.append((name, -1))
            continue
        part = min(1.0, r["rest"] / r["own"])
        base = np.floor(part * free + 1e-9).astype(np.int64)
        left -= int((base * lengths).sum())
        if left < 0:  # long documents beyond their share by rounding alone
            base, left = np.zeros_like(base), left + int((base * lengths).sum())
        sizes = np.array([t for _, t, _ in around], np.int64)
        every, back = np.unique(np.concatenate([lengths, sizes]), return_inverse=True)
        room = np.bincount(back, weights=np.concatenate([free - base, np.ones(len(sizes), np.int64)]), minlength=len(every)).astype(np.int64)
        more = subset_counts(every, room, max(0, left))
        counts += [(name, int(x), int(n)) for x, n in zip(lengths, base + more[: len(every)][back[: len(lengths)]]) if n] if len(lengths) else []
        wanted = {int(x): int(n) for x, n in zip(every, more) if x > LONG and n}
        picked.append((name, around[0][0] if around else 0))
        for place, tokens, _ in around:
            if wanted.get(tokens, 0) > 0:
                wanted[tokens] -= 1
                picked.append((name, place, True))
    chosen = ordinals(sized.where(F.col("tokens") <= LONG).withColumn("order", F.xxhash64("id", F.lit(seed + 1))), ["source", "tokens"], "order")
    table = spark.createDataFrame(counts, "source string, tokens bigint, take bigint")
    chosen = chosen.join(F.broadcast(table) if len(counts) <= BROADCAST_ROWS else table, ["source", "tokens"], "left")
    chosen = chosen.select("id", "source", "tokens", (F.col("ordinal") < F.coalesce("take", F.lit(0))).alias("more"))
    before = F.element_at(F.create_map(*(F.lit(x) for row in picked if len(row) == 2 for x in row)), F.col("source"))
    single = spark.createDataFrame([row for row in picked if len(row) == 3], "source string, place bigint, hit boolean")
    far = long.join(F.broadcast(single), ["source", "place"], "left").select("id", "source", "tokens", ((F.col("place") < before) | F.coalesce("hit", F.lit(False))).alias("more"))
    whole = F.element_at(F.create_map(*(F.lit(x) for name, r in first.items() for x in (name, r["whole"]))), F.col("source"))
    return chosen.union(far).select("id", "source", "tokens", (whole + F.col("more").cast("int")).cast("int").alias("copies")).where("copies > 0")


def _bounded(rows: DataFrame, most: int) -> list:
    """The rows, at most `most` of them: counts by source and length, never documents."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} counts of sources and lengths; list fewer sources")
    return found


def mixture_report(df: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """(source, weight, max_repeats, documents, own_tokens, target_tokens, short, reached_tokens, share): the budgets of the listed sources, `source` as written in `targets`, beside what each contributes to the mixture of `mix`.

    `short`: even max_repeats times its own tokens do not reach the target.
    Sources are compared trimmed and in lower case; null sources of documents
    match none; a null weight counts as 0 and null max_repeats as 1. `share`
    is null for an empty mixture.
    """
    sized, listed = _measured(df, targets, key, text, source)
    reached = _mixed(sized, listed, seed).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached_tokens")).withColumnRenamed("source", "_s")
    rows = _budgets(df, listed)
    rows = rows.join(reached, F.lower(F.regexp_replace("source", r"(?U)^\s+|\s+$", "")) == F.col("_s"), "left").drop("_s").withColumn("reached_tokens", F.coalesce("reached_tokens", F.lit(0)))
    total = rows.agg(F.sum("reached_tokens").alias("_total"))
    return rows.crossJoin(F.broadcast(total)).withColumn("share", F.try_divide("reached_tokens", "_total")).drop("_total")
