"""Sinks and the tables of an index: chunks, postings, term and document statistics, vectors, and their metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import terms
from quern.operators.lexical import idf, term_counts

POINTER = "version string, signature string, model string, dim int, built_at string, rows bigint"


@dataclass(frozen=True)
class Index:
    """Folders of an index below `root`; a build writes a version and then adds a pointer to it, a new file that replaces none, so readers never see half of one."""

    root: str

    def about(self, spark: SparkSession) -> dict | None:
        """What the newest pointer says: version, signature, model, dim, built_at and rows; None where nothing was built."""
        try:
            pointers = spark.read.schema(POINTER).json(f"{self.root}/pointers")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise
        rows = pointers.orderBy(F.desc("built_at"), F.desc("version")).limit(1).collect()
        return rows[0].asDict() if rows else None

    def version(self, spark: SparkSession) -> str | None:
        found = self.about(spark)
        return found["version"] if found else None

    def read(self, spark: SparkSession, table: str, model: str | None = None, dim: int | None = None) -> DataFrame:
        """A table of the newest version; an index of another model or vector length than asked for is an error."""
        found = self.about(spark)
        if found is None:
            raise FileNotFoundError(f"no index in {self.root}")
        for name, asked in (("model", model), ("dim", dim)):
            if asked is not None and found[name] != asked:
                raise ValueError(f"the index was built with {name} {found[name]!r}, not {asked!r}")
        version = found["version"]
        return spark.read.parquet(f"{self.root}/{version}/{table}")


def signature(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(signature): one hash over all paths and texts, independent of their order."""
    rows = docs.select(F.sha2(F.concat_ws("\0", path, text), 256).alias("h")).select(*(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)").alias(f"p{i}") for i in range(5)))
    return rows.agg(F.sha2(F.concat_ws("|", *(F.coalesce(F.sum(f"p{i}"), F.lit(0)).cast("string") for i in range(5)), F.count("*").cast("string")), 256).alias("signature"))


def build(index: Index, chunks: DataFrame, vectors: DataFrame, built: str, version: str, corpus_signature: str, model: str) -> None:
    """Writes all tables of a version, postings bucketed by term through range partitioning, then points to it."""
    at = f"{index.root}/{version}"
    chunks.write.mode("overwrite").parquet(f"{at}/chunks")
    stored = chunks.sparkSession.read.parquet(f"{at}/chunks")
    counts = term_counts(stored, "id", "text")
    counts.repartitionByRange("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{at}/postings")
    sizes = stored.select("id", F.size(terms(F.col("text"))).alias("dl"))
    sizes.write.mode("overwrite").parquet(f"{at}/documents")
    total = sizes.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    total.write.mode("overwrite").parquet(f"{at}/corpus")
    df = chunks.sparkSession.read.parquet(f"{at}/postings").groupBy("term").agg(F.count("*").alias("df"))
    df.crossJoin(F.broadcast(total)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf")).write.mode("overwrite").parquet(f"{at}/terms")
    vectors.withColumn("embedding", F.col("embedding").cast("array<float>")).write.mode("overwrite").parquet(f"{at}/vectors")
    spark = chunks.sparkSession
    rows = stored.count()
    found = spark.read.parquet(f"{at}/vectors").select(F.size("embedding").alias("d")).limit(1).collect()
    about = spark.createDataFrame([(version, corpus_signature, model, found[0]["d"] if found else None, built, rows)], POINTER)
    about.coalesce(1).write.mode("append").json(f"{index.root}/pointers")


def fresh(index: Index, spark: SparkSession, corpus_signature: str, model: str) -> bool:
    """Whether the newest version was built from this corpus with this model."""
    found = index.about(spark)
    return found is not None and found["signature"] == corpus_signature and found["model"] == model


def write_embedding_cache(rows: DataFrame, path: str) -> None:
    """Vectors (hash, embedding, backend, model) as JSON lines with their length, what `readers.read_embedding_cache` reads; an existing folder is replaced once all files are written."""
    rows.select("hash", F.col("embedding").cast("array<float>").alias("embedding"), "backend", "model", F.size("embedding").alias("dim")).write.mode("overwrite").json(path)


def write_answer_cache(rows: DataFrame, path: str, signature: str | None) -> None:
    """Answers (key, answer) as JSON lines with the signature of the corpus they were made from; of equal keys the smallest answer stays. An existing folder is replaced once all files are written."""
    once = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("answer").alias("answer"))
    once.withColumn("corpus", F.lit(signature).cast("string")).write.mode("overwrite").json(path)


def append_log(rows: DataFrame, path: str, keep_text: bool = False, most_rows: int = 1_000_000) -> None:
    """Query-log rows as JSON lines, without chunk texts unless asked for, in files of bounded size."""
    if not keep_text and "retrieved_chunks" in rows.columns:
        rows = rows.withColumn("retrieved_chunks", F.transform("retrieved_chunks", lambda c: c.dropFields("text", "chunk")))
    rows.write.mode("append").option("maxRecordsPerFile", most_rows).json(path)
