"""Sources: documents of several formats, chunk and evaluation tables, caches and word lists."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ElementTree
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as tx

METADATA = "struct<dates:array<string>,urls:array<string>,emails:array<string>,slug:string,section_type:string,section_importance:string,breadcrumb:string,is_hub:boolean,extra:map<string,string>>"
CHUNKS = f"id string, article_id string, title string, url string, section string, subsection string, text string, doc_path string, doc_name string, section_idx int, chunk_idx int, char_count int, word_count int, metadata {METADATA}"
EVALUATION = "query string, difficulty string, tags array<string>, language string, notes string, relevant_chunk_ids array<string>, relevant_chunks array<struct<title:string,section:string,keywords_matched:array<string>>>"
EMBEDDINGS = "hash string, embedding array<float>, backend string, model string, dim int"


def docx_text(data: bytes) -> str:
    """Paragraphs of a word-processor file, a line each."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))


def pdf_text(data: bytes) -> str:
    """Pages of a portable document, a line break behind each; needs a reader library that may be missing."""
    from pypdf import PdfReader

    return "".join((page.extract_text() or "") + "\n" for page in PdfReader(io.BytesIO(data)).pages)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, errors = [], []
        for kind, data in zip(batch.column("kind").to_pylist(), batch.column("content").to_pylist()):
            try:
                texts.append(docx_text(data) if kind == "docx" else pdf_text(data) if kind == "pdf" else data.decode("utf-8", "ignore"))
                errors.append(None)
            except Exception as error:  # noqa: BLE001  a broken file is a row with its error, not a failed job
                texts.append(None)
                errors.append(f"{type(error).__name__}: {error}"[:300])
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("kind"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "kind", "text", "error"])


def read_documents(spark: SparkSession, folder: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(path, kind, text, error) of every file below a folder, or of those with one of the extensions; markup is reduced to its text, unknown extensions are read as plain text, unreadable files keep a null text and their error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = files.select("path", kind.alias("kind"), "content")
    if kinds is not None:
        rows = rows.where(F.col("kind").isin(*kinds))
    rows = rows.mapInArrow(_decode, "path string, kind string, text string, error string")
    return rows.withColumn("text", F.when(F.col("kind").isin("html", "htm"), tx.html_text(F.col("text"))).otherwise(F.col("text")))


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of every *.md file below a folder, undecodable bytes ignored."""
    return read_documents(spark, folder, ("md",)).select("path", "text")


def as_article(title: Column, url: Column, text: Column) -> Column:
    """A text as a marked article: heading, url and its non-blank lines."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.concat(F.lit("# [ARTICLE] "), title, F.lit("\n"), url, F.lit("\n\n"), F.array_join(lines, "\n"))


def article_issues(text: Column) -> Column:
    """What is wrong with an ingested text: no article heading, too short, nothing but headings."""
    body = F.exists(F.split(text, "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    checks = F.array(F.when(~text.rlike(r"(?m)^# \[ARTICLE\].*$"), F.lit("no article heading")), F.when(F.length(F.trim(text)) < 10, F.lit("too short")), F.when(~body, F.lit("no content")))
    return F.filter(checks, lambda x: x.isNotNull())


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows from JSON lines; blank lines are skipped."""
    return spark.read.schema(CHUNKS).json(path)


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions from JSON lines, with labels by chunk id or by title and section."""
    return spark.read.schema(EVALUATION).json(path)


def read_embedding_cache(spark: SparkSession, path: str, dim: int, backend: str | None = None) -> DataFrame:
    """Vectors by content hash: malformed rows, other lengths and other backends are left out; of one hash the last in file order stays."""
    rows = spark.read.schema(EMBEDDINGS).option("mode", "PERMISSIVE").json(path).select("*", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row")).alias("at"))
    rows = rows.where(F.col("hash").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") == dim))
    if backend:
        rows = rows.where(F.col("backend") == backend)
    last = rows.groupBy("hash").agg(F.max_by(F.struct("embedding", "backend", "model", "dim"), "at").alias("s"))
    return last.select("hash", "s.*")


def read_synonyms(spark: SparkSession, path: str, most: int = 10_000) -> DataFrame:
    """(term, ord, synonym) from a JSON object of lists: terms in lower case, synonyms trimmed, empty ones left out."""
    rows = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    terms = rows.select(F.explode("m").alias("term", "more")).select(F.lower(F.trim("term")).alias("term"), F.posexplode("more").alias("ord", "synonym"))
    rows = terms.select("term", "ord", F.trim("synonym").alias("synonym")).where("term <> '' and synonym <> ''")
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} synonyms")
    return rows


def read_answer_cache(spark: SparkSession, path: str, signature: str | None = None) -> DataFrame:
    """(key, answer) of a cache of answers as `tables.write_answer_cache` writes it; one that was made from another corpus than `signature`, or says of none, has no rows, and neither has a missing one."""
    schema = "key string, answer string, corpus string"
    try:
        rows = spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], schema)
    return (rows if signature is None else rows.where(F.col("corpus") == signature)).select("key", "answer")


def corpus_signature(meta: Column) -> Column:
    """The signature that index metadata (a map) names: kb_sha256, else kb_sha, else kb_signature; empty ones don't count."""
    return F.coalesce(*(F.when(meta[k] != "", meta[k]) for k in ("kb_sha256", "kb_sha", "kb_signature")))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(question) per line; blank lines and those that start with # are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("question")).where("question <> '' and not startswith(question, '#')")


def read_metric_lines(spark: SparkSession, path: str) -> DataFrame:
    """Query-log rows from JSON lines, broken lines left out."""
    return spark.read.option("mode", "DROPMALFORMED").schema("correlation_id string, timestamp double, query string, refused boolean, latency_ms double, chunk_ids array<string>").json(path)

