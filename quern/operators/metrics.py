"""Operational metrics over a long table of samples (ts, kind, name, labels, value): counters, gauges, histograms, summaries, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.lexical import small
from quern.plans.session import cut_lineage

#: Samples of a histogram that count, newest first, and the parts in which a series is cut to them.
HISTORY, PARTS = 10_000, 32
#: Equal steps between a group's smallest and largest value among which a rank is sought.
STEPS = 1_000
QUANTILES = (0.5, 0.95, 0.99)


def label_key(labels: Column) -> Column:
    """A label map as {k=v,...} with sorted keys, empty for null or empty maps: maps can't be grouped, this can."""
    pairs = F.array_sort(F.map_entries(labels))
    text = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ",")
    return F.when(labels.isNull() | (F.size(labels) == 0), F.lit("")).otherwise(F.concat(F.lit("{"), text, F.lit("}")))


def samples(events: DataFrame) -> DataFrame:
    """(kind, name, labels, ts, received_at, value, collector): whole repeated rows once, values that are null or no number left out, labels as text."""
    rows = events.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("labels", label_key(F.col("labels")))
    return rows.select("kind", "name", "labels", "ts", "received_at", "value", "collector").distinct()


def counters(rows: DataFrame) -> DataFrame:
    """(name, labels, total): the sum of every counter series; negative steps don't count."""
    return rows.where("kind = 'counter' and value >= 0").groupBy("name", "labels").agg(F.sum("value").alias("total"))


def gauges(rows: DataFrame) -> DataFrame:
    """(name, labels, value): the newest value of every gauge series; among equal times the one received last, then the largest."""
    return rows.where("kind = 'gauge'").groupBy("name", "labels").agg(F.max_by("value", F.struct("ts", "received_at", "value")).alias("value"))


def histograms(rows: DataFrame, history: int = HISTORY) -> DataFrame:
    """(name, labels, count, min, max, mean, p50, p95, p99) over the last `history` samples of every series.

    A percentile is the sample of nearest rank, round-half-even(p (n - 1))
    from 0. A series is cut to its newest samples in PARTS parts first, then
    as a whole, so no task sorts more of it than a part or PARTS x `history`.
    """
    last = rows.where("kind = 'histogram'").withColumn("_part", F.pmod(F.xxhash64("ts", "received_at", "value"), F.lit(PARTS)))
    for by in (["name", "labels", "_part"], ["name", "labels"]):
        newest = Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("received_at"), F.desc("value"))
        last = last.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= history)
    sorted_values = F.array_sort(F.collect_list("value"))
    g = last.groupBy("name", "labels").agg(F.count("*").alias("count"), sorted_values.alias("v"), F.avg("value").alias("mean"))

    def rank(p: float) -> Column:
        return F.element_at("v", (F.bround(F.lit(p) * (F.col("count") - 1), 0) + 1).cast("int"))

    return g.select("name", "labels", "count", F.element_at("v", 1).alias("min"), F.element_at("v", -1).alias("max"), "mean", *(rank(p).alias(f"p{int(p * 100)}") for p in QUANTILES))


def summary(rows: DataFrame) -> DataFrame:
    """(name, counter, mean, p95): series rolled up over their labels; the mean weighted by count, the largest p95."""
    c = counters(rows).groupBy("name").agg(F.sum("total").alias("counter"))
    h = histograms(rows).groupBy("name").agg((F.sum(F.col("mean") * F.col("count")) / F.sum("count")).alias("mean"), F.max("p95").alias("p95"))
    return c.join(h, "name", "full").select("name", "counter", "mean", "p95")


def exposition(rows: DataFrame) -> DataFrame:
    """(metric, labels, value): text-exposition rows: counters and gauges as they are, histograms as count, sum and quantiles."""
    plain = counters(rows).select(F.col("name").alias("metric"), "labels", F.col("total").alias("value")).union(gauges(rows))
    h = histograms(rows)
    parts = F.array(
        F.struct(F.lit("_count").alias("suffix"), F.lit("").alias("q"), F.col("count").cast("double").alias("value")),
        F.struct(F.lit("_sum").alias("suffix"), F.lit("").alias("q"), (F.col("mean") * F.col("count")).alias("value")),
        *(F.struct(F.lit("").alias("suffix"), F.lit(f"quantile={p}").alias("q"), F.col(f"p{int(p * 100)}").alias("value")) for p in QUANTILES),
    )
    flat = h.select("name", "labels", F.explode(parts).alias("x"))
    inner = F.when(F.col("x.q") == "", F.col("labels")).when(F.col("labels") == "", F.concat(F.lit("{"), F.col("x.q"), F.lit("}"))).otherwise(F.concat(F.lit("{"), F.col("x.q"), F.lit(","), F.expr("substring(labels, 2)")))
    return plain.union(flat.select(F.concat("name", "x.suffix"), inner, F.col("x.value")))


def export_rows(rows: DataFrame) -> DataFrame:
    """(metric_type, metric_name, labels, value): what a flat export holds: counters, gauges and the means of histograms."""
    part = lambda df, kind, value: df.select(F.lit(kind).alias("metric_type"), F.col("name").alias("metric_name"), "labels", F.col(value).alias("value"))
    return part(counters(rows), "counter", "total").union(part(gauges(rows), "gauge", "value")).union(part(histograms(rows), "histogram_mean", "mean"))


def query_records(responses: DataFrame, key: str = "response_id") -> DataFrame:
    """One flat record a response for a log of queries: lengths, a preview of the question, refusal, confidence, times (0 where unknown) and routing (unknown where there is none)."""
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    time = lambda c: F.coalesce(f"timing.{c}", F.lit(0.0)).alias(c)
    return responses.select(key, size("question").alias("question_length"), F.left("question", F.lit(100)).alias("question_preview"), size("answer").alias("answer_length"), F.coalesce("refused", F.lit(False)).alias("refused"), "confidence", time("total_ms"), time("retrieve_ms"), time("llm_ms"), F.coalesce("routing.action", F.lit("unknown")).alias("action"), F.coalesce("routing.level", F.lit("unknown")).alias("level"), F.coalesce("routing.escalated", F.lit(False)).alias("escalated"))


def profile_summary(profiles: DataFrame) -> DataFrame:
    """One row of means over retrieval profiles (dense_dot_time_ms, dense_computed, dense_saved, dense_total, candidates, used_faiss, used_hnsw): missing numbers count as 0, the ratio is saved over total, and the kind of search is the first of faiss and hnsw that was used, else linear. No profiles, no row."""
    n = lambda c: F.coalesce(c, F.lit(0))
    used = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    total = F.sum(n("dense_total"))
    g = profiles.agg(F.when(used("used_faiss"), "faiss").when(used("used_hnsw"), "hnsw").otherwise("linear").alias("ann_mode"), F.bround(F.avg(n("dense_dot_time_ms")), 3).alias("dense_dot_ms_mean"), F.bround(F.avg(n("dense_computed")), 2).alias("dense_computed_mean"), F.bround(F.avg(n("dense_saved")), 2).alias("dense_saved_mean"), F.when(total != 0, F.bround(F.sum(n("dense_saved")) / total, 3)).otherwise(0.0).alias("dense_saved_ratio"), F.bround(F.avg(n("candidates")), 2).alias("candidates_mean"), F.count("*").alias("_n"))
    return g.where("_n > 0").drop("_n")


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 days") -> DataFrame:
    """(window_start, name, n, total): counters per tumbling window of event time; works on streams (with a watermark of `late`) and on tables."""
    rows = events.where("kind = 'counter' and value >= 0 and not isnan(value)")
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    g = rows.groupBy(F.window("ts", every), "name").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("window_start"), "name", "n", "total")


def values_at(rows: DataFrame, ranks: DataFrame, by: str, value: str) -> DataFrame:
    """(by, rank, value): the values at the given ranks (by, lo, hi, rank), from 1, of each group in order of value; lo and hi are its smallest and largest.

    Values are counted in STEPS equal steps between lo and hi; only the rows
    of the steps that hold a rank are sorted, so a group with a third of all
    rows is no single sort unless its values lie that close.
    """
    limits = ranks.select(by, "lo", "hi").distinct()
    place = F.when(F.col("hi") > F.col("lo"), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * STEPS).cast("int"))
    placed = rows.join(small(limits), by).select(by, value, F.coalesce(place, F.lit(0)).alias("step"))
    counts = placed.groupBy(by, "step").agg(F.count("*").alias("c"))
    until = counts.withColumn("until", F.sum("c").over(Window.partitionBy(by).orderBy("step")))
    held = until.join(ranks.select(by, "rank"), by).where((F.col("rank") <= F.col("until")) & (F.col("rank") > F.col("until") - F.col("c")))
    held = held.select(by, "step", "rank", (F.col("rank") - (F.col("until") - F.col("c"))).alias("inside"))
    near = placed.join(small(held.select(by, "step").distinct()), [by, "step"], "left_semi")
    near = near.withColumn("inside", F.row_number().over(Window.partitionBy(by, "step").orderBy(value)))
    return near.join(small(held), [by, "step", "inside"]).select(by, "rank", value)


def bench_summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, mean, median, stdev, min, max, p95): p95 is the sorted sample at int(0.95 n), the median the mean of the middle two, stdev of the sample."""
    rows = rows.where(F.col(value).isNotNull()).select(by, value)
    g = cut_lineage(rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("stdev"), F.min(value).alias("min"), F.max(value).alias("max")))
    n = F.col("n")
    wanted = F.array(F.floor((n + 1) / 2), F.floor(n / 2) + 1, F.least(F.floor(n * 0.95) + 1, n))
    ranks = g.select(by, F.col("min").alias("lo"), F.col("max").alias("hi"), F.explode(F.array_distinct(wanted)).alias("rank"))
    found = values_at(rows, ranks, by, value).groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("rank", value))).alias("at"))
    rows = g.join(found, by).withColumn("w", wanted)
    at = lambda i: F.element_at("at", F.col("w")[i])
    return rows.select(by, "n", "mean", ((at(0) + at(1)) / 2).alias("median"), "stdev", "min", "max", at(2).alias("p95"))
