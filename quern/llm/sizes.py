"""Sizes of texts in tokens, and places within a size class without a hot spot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.session import partitions_of

#: The public word-and-punctuation rule `\w+|[^\w\s]+` with Unicode letters, digits and spaces.
TOKEN = r"(?U)[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f]+"


def token_count(text: Column) -> Column:
    """Tokens of a text by the word-and-punctuation rule; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")


def ordinals(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """rows with `ordinal`, counted from 0 within each value of `by`.

    A class is split by a hash of `order` before it is sorted, and the parts
    are put behind one another by their counts, so that a class with a third
    of all rows is no single task. The same rows get the same ordinals when a
    lost task runs again.
    """
    salt = 4 * partitions_of(rows.sparkSession)
    rows = rows.withColumn("part", F.pmod(F.xxhash64(order, F.lit(3)), F.lit(salt)))
    counts = rows.groupBy(*by, "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("part")) - F.col("n")
    offsets = counts.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("part").alias("_part"), before.alias("before"))
    same = F.col("part") == F.col("_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    place = F.row_number().over(Window.partitionBy(*by, "part").orderBy(order)) - 1
    return rows.withColumn("place", place).join(offsets, same).withColumn("ordinal", F.col("before") + F.col("place")).drop("part", "_part", "before", "place", *(f"_{c}" for c in by))


def running(rows: DataFrame, by: str, size: str, order: str) -> DataFrame:
    """rows with `place`, counted from 0, and `sum`, the running sum of `size`, within each value of `by` in an order by hash; in salted parts as in `ordinals`."""
    salt = 4 * partitions_of(rows.sparkSession)
    rows = rows.withColumn("part", F.pmod(F.xxhash64(order, F.lit(3)), F.lit(salt)))
    parts = rows.groupBy(by, "part").agg(F.count("*").alias("n"), F.sum(size).alias("s"))
    until = Window.partitionBy(by).orderBy("part")
    offsets = parts.select(F.col(by).alias("_by"), F.col("part").alias("_part"), (F.sum("n").over(until) - F.col("n")).alias("_n"), (F.sum("s").over(until) - F.col("s")).alias("_s"))
    within = Window.partitionBy(by, "part").orderBy(order, size)
    placed = rows.select("*", (F.row_number().over(within) - 1).alias("place"), F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, 0)).alias("sum"))
    joined = placed.join(offsets, (F.col("part") == F.col("_part")) & F.col(by).eqNullSafe(F.col("_by")))
    return joined.withColumn("place", F.col("place") + F.col("_n")).withColumn("sum", F.col("sum") + F.col("_s")).drop("part", "_part", "_by", "_n", "_s")
