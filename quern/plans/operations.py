"""Registered queries on metrics, request state and the embedding cache, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import metrics as mt
from quern.operators import state as st
from quern.operators import embeddings as em
from quern.plans.retrieval import DIM, MODEL, chunk_texts, table
from quern.plans.session import cut_lineage


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    return mt.samples(table(spark, folder, "metric_events"))


def metric_counters(spark: SparkSession, folder: str) -> DataFrame:
    return mt.counters(_samples(spark, folder)).withColumn("total", F.round("total", 6))


def metric_gauges(spark: SparkSession, folder: str) -> DataFrame:
    return mt.gauges(_samples(spark, folder)).withColumn("value", F.round("value", 6))


def metric_histograms(spark: SparkSession, folder: str) -> DataFrame:
    rows = mt.histograms(_samples(spark, folder))
    return rows.select("name", "labels", "count", *(F.round(c, 6).alias(c) for c in ("min", "max", "mean", "p50", "p95", "p99")))


def metric_summary(spark: SparkSession, folder: str) -> DataFrame:
    return mt.summary(cut_lineage(_samples(spark, folder))).select("name", *(F.round(c, 6).alias(c) for c in ("counter", "mean", "p95")))


def metric_exposition(spark: SparkSession, folder: str) -> DataFrame:
    return mt.exposition(cut_lineage(_samples(spark, folder))).withColumn("value", F.round("value", 6))


def metric_export(spark: SparkSession, folder: str) -> DataFrame:
    return mt.export_rows(cut_lineage(_samples(spark, folder))).withColumn("value", F.round("value", 6))


def query_records(spark: SparkSession, folder: str) -> DataFrame:
    return mt.query_records(table(spark, folder, "query_responses"))


def metric_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = mt.windowed_counts(table(spark, folder, "metric_events"))
    return rows.select(F.unix_seconds("window_start").alias("start"), "name", "n", F.round("total", 6).alias("total"))


def latency_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "query_responses").select(F.coalesce("routing.level", F.lit("none")).alias("level"), "processing_time_ms")
    return mt.bench_summary(rows, "level", "processing_time_ms").select("level", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "stdev", "min", "max", "p95")))


def late_events(spark: SparkSession, folder: str) -> DataFrame:
    """Per collector the samples received more than a minute after their time, whole repeats once."""
    rows = table(spark, folder, "metric_events").select("ts", "received_at", "collector", "kind", "name", mt.label_key(F.col("labels")).alias("labels"), "value").distinct()
    late = F.unix_micros("received_at") - F.unix_micros("ts") > 60_000_000
    return rows.groupBy("collector").agg(F.count("*").alias("n"), F.count_if(late).alias("late"))


def rate_limit(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "query_responses").where("responded_at is not null").withColumn("user", F.coalesce("routing.level", F.lit("none")))
    return st.rate_limit(rows.select("user", "responded_at", "response_id"), "user", "responded_at", ["response_id"], ["response_id"], most=10, seconds=600.0)


def query_cache(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "query_responses").where("question is not null").select("response_id", "responded_at", F.md5(F.lower(F.trim("question"))).alias("entry"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("entry"), F.lit(64)))
    return st.cache_outcomes(rows, "shard", "entry", "responded_at", ["response_id"], ["response_id"], size=100, ttl_seconds=3600.0)


def circuit_breaker(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "metric_events").where("kind = 'counter'").select("collector", "ts", "name", (~F.col("name").contains("error")).alias("ok")).distinct()
    return st.breaker_states(rows, "collector", "ok", "ts", ["name"], ["collector", "ts", "name"])


def _cache(spark: SparkSession, folder: str) -> DataFrame:
    return em.cache(table(spark, folder, "embedding_responses"), MODEL, DIM)


def embedding_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The newest usable vector of each content hash, by id, with the number of usable ones."""
    return _cache(spark, folder).select("hash", "vec_id", "n")


def cache_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk with the cached vector of its content, if there is one: a changed text with an old vector is a miss."""
    return em.lookup(chunk_texts(spark, folder), _cache(spark, folder)).select("id", "hash", "vec_id")


def cache_misses(spark: SparkSession, folder: str) -> DataFrame:
    """Contents without a usable vector: what an incremental build embeds."""
    return em.misses(chunk_texts(spark, folder), _cache(spark, folder)).select("hash")


def cache_prune(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of the cache whose content is in no chunk any more."""
    return em.stale(chunk_texts(spark, folder), _cache(spark, folder)).select("hash", "vec_id")


_S = """with s as (select distinct kind, name, case when labels is null or cardinality(labels) = 0 then '' else '{' || array_to_string(list_transform(list_sort(map_entries(labels)), lambda e: e.key || '=' || coalesce(e.value, '')), ',') || '}' end as labels, ts, received_at, value, collector
  from metric_events where value is not null and not isnan(value)),
c as (select name, labels, sum(value) as total from s where kind = 'counter' and value >= 0 group by all),
g as (select name, labels, value from (select *, row_number() over (partition by name, labels order by ts desc nulls last, received_at desc nulls last, value desc) as r from s where kind = 'gauge') where r = 1),
hl as (select name, labels, value from (select *, row_number() over (partition by name, labels order by ts desc nulls last, received_at desc nulls last, value desc) as r from s where kind = 'histogram') where r <= 10000),
h as (select name, labels, count(*) as count, list_sort(list(value)) as v, avg(value) as mean from hl group by all),
hs as (select name, labels, count, v[1] as min, v[-1] as max, mean, v[cast(round_even(0.5::double*(count-1), 0) as bigint)+1] as p50, v[cast(round_even(0.95::double*(count-1), 0) as bigint)+1] as p95, v[cast(round_even(0.99::double*(count-1), 0) as bigint)+1] as p99 from h)"""
_OK = f"model = '{MODEL}' and len(embedding) = {DIM} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIM} and len(list_filter(embedding, lambda x: x <> 0)) > 0"
_IN = "case when labels = '' then '{' || q || '}' else '{' || q || ',' || substr(labels, 2) end"
SQL = {
    "metric_counters": f"{_S} select name, labels, round(total, 6) as total from c",
    "metric_gauges": f"{_S} select name, labels, round(value, 6) as value from g",
    "metric_histograms": f"{_S} select name, labels, count, round(min, 6) as min, round(max, 6) as max, round(mean, 6) as mean, round(p50, 6) as p50, round(p95, 6) as p95, round(p99, 6) as p99 from hs",
    "metric_summary": f"{_S}, a as (select name, sum(total) as counter from c group by name), b as (select name, sum(mean*count)/sum(count) as mean, max(p95) as p95 from hs group by name) select name, round(counter, 6) as counter, round(mean, 6) as mean, round(p95, 6) as p95 from a full join b using(name)",
    "metric_exposition": f"""{_S} select name as metric, labels, round(total, 6) as value from c union all select name, labels, round(value, 6) from g union all select name || '_count', labels, count from hs union all select name || '_sum', labels, round(mean*count, 6) from hs
      union all select name, {_IN}, round(v, 6) from (select name, labels, 'quantile=0.5' as q, p50 as v from hs union all select name, labels, 'quantile=0.95', p95 from hs union all select name, labels, 'quantile=0.99', p99 from hs)""",
    "metric_export": f"{_S} select 'counter' as metric_type, name as metric_name, labels, round(total, 6) as value from c union all select 'gauge', name, labels, round(value, 6) from g union all select 'histogram_mean', name, labels, round(mean, 6) from hs",
    "query_records": """select response_id, coalesce(length(question), 0) as question_length, left(question, 100) as question_preview, coalesce(length(answer), 0) as answer_length, coalesce(refused, false) as refused, confidence, coalesce(timing.total_ms, 0) as total_ms, coalesce(timing.retrieve_ms, 0) as retrieve_ms, coalesce(timing.llm_ms, 0) as llm_ms,
      coalesce(routing.action, 'unknown') as action, coalesce(routing.level, 'unknown') as level, coalesce(routing.escalated, false) as escalated from query_responses""",
    "metric_windows": "select cast(floor(epoch_us(ts) / 3600000000) as bigint) * 3600 as start, name, count(*) as n, round(sum(value), 6) as total from metric_events where kind = 'counter' and value >= 0 and not isnan(value) and ts is not null group by all",
    "latency_summary": """with r as (select coalesce(routing.level, 'none') as level, processing_time_ms as x from query_responses where processing_time_ms is not null), o as (select *, row_number() over (partition by level order by x) as r, count(*) over (partition by level) as n from r)
      select level, any_value(n) as n, round(avg(x), 6) as mean, round(median(x), 6) as median, round(stddev_samp(x), 6) as stdev, round(min(x), 6) as min, round(max(x), 6) as max, round(max(x) filter (where r = least(floor(n*0.95)+1, n)), 6) as p95 from o group by level""",
    "late_events": "select collector, count(*) as n, count(*) filter (where epoch_us(received_at) - epoch_us(ts) > 60000000) as late from (select distinct ts, received_at, collector, kind, name, case when labels is null or cardinality(labels) = 0 then '' else array_to_string(list_transform(list_sort(map_entries(labels)), lambda e: e.key || '=' || coalesce(e.value, '')), ',') end as labels, value from metric_events) group by collector",
    "embedding_cache": f"select hash, vec_id, n from (select hash, vec_id, count(*) over (partition by hash) as n, row_number() over (partition by hash order by created_at desc nulls last, vec_id desc) as r from embedding_responses where hash is not null and {_OK}) where r = 1",
    "cache_lookup": f"with k as (select distinct id, left(sha1(text), 16) as hash from chunks where id is not null and text is not null), v as (select hash, vec_id from (select hash, vec_id, row_number() over (partition by hash order by created_at desc nulls last, vec_id desc) as r from embedding_responses where hash is not null and {_OK}) where r = 1) select id, hash, vec_id from k left join v using (hash)",
    "cache_misses": f"select distinct left(sha1(text), 16) as hash from chunks where id is not null and text is not null and left(sha1(text), 16) not in (select hash from embedding_responses where hash is not null and {_OK})",
    "cache_prune": f"select hash, vec_id from (select hash, vec_id, row_number() over (partition by hash order by created_at desc nulls last, vec_id desc) as r from embedding_responses where hash is not null and {_OK}) where r = 1 and hash not in (select left(sha1(text), 16) from chunks where id is not null and text is not null)",
}
QUERIES = (metric_counters, metric_gauges, metric_histograms, metric_summary, metric_exposition, metric_export, query_records, metric_windows, latency_summary, late_events, rate_limit, query_cache, circuit_breaker, embedding_cache, cache_lookup, cache_misses, cache_prune)
