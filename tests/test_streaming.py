from pyspark.sql import functions as F

from quern.operators import metrics, state
from quern.streaming import operators as streams


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_limiter_same_as_batch(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").cast("int").alias("n"), (F.col("id") % 3).cast("string").alias("key"), F.timestamp_seconds(F.col("id") * 7 % 400).alias("at"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = {(r.key, r.n): r.allowed for r in state.rate_limit(rows, "key", "at", ["n"], ["key", "n"], most=4, seconds=60).collect()}
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = {(r.key, r.n): r.allowed for r in run(streams.limit_stream(stream, "key", "at", "n", most=4, seconds=60), "limited").collect()}
    assert got == batch and len(set(got.values())) == 2


def test_breaker_same_as_batch(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").cast("int").alias("n"), F.lit("k").alias("key"), F.timestamp_seconds(F.col("id") * 9).alias("at"), (F.col("id") % 7 == 0).alias("ok"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = {r.n: r.state for r in state.breaker_states(rows, "key", "ok", "at", ["n"], ["n"]).collect()}
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = {r.n: r.state for r in run(streams.breaker_stream(stream, "key", "ok", "at", "n"), "broken").collect()}
    assert got == batch and "open" in got.values()


def test_windows_on_streams(spark, tmp_path):
    rows = spark.range(300).select(F.timestamp_seconds(F.col("id") * 100).alias("ts"), F.lit("counter").alias("kind"), F.lit("hits").alias("name"), F.lit(1.0).alias("value"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    whole = {r.window_start: r.n for r in metrics.windowed_counts(rows).collect()}
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = {r.window_start: r.n for r in run(streams.windowed_counts(stream, late="1 hour"), "windows").collect()}
    assert got and all(whole[k] == v for k, v in got.items())
