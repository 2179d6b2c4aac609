"""Registered queries of the numbered problems; see TESTDATA.md for their terms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import mixing, nearduplicates, neighbours, packing, pairs, repeatedlines, splitting, sql, textkinds

#: Lengths of the two models' vectors (TESTDATA.md).
DIMS = {"lark-embed-m": 64, "lark-embed-s": 48}


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Per chunk id its near-duplicate class and number of similar texts."""
    return nearduplicates.near_duplicates(_read(spark, folder, "chunks"), "id", "text", words=3, threshold=0.5)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return nearduplicates.group_pairs(p1_groups(spark, folder))


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All chunk texts as pieces of at most 1,600 characters with 200 of overlap."""
    return splitting.split_oversized(_read(spark, folder, "chunks"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that had to be cut, by the cuts of their pieces."""
    return p2_pieces(spark, folder).where("piece_no = 0 and cut <> 'end'").select("id", "boundary").distinct()


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """For every usable vector its five most similar ones."""
    return neighbours.most_similar(_read(spark, folder, "embedding_responses"), DIMS, k=5)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_neighbours(spark, folder).where(F.col("cosine") >= 0.9 - 1e-9).select(F.least("a", "b").alias("vec_a"), F.greatest("a", "b").alias("vec_b")).distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeatedlines.repeated_places(_read(spark, folder, "chunks")).select("id", "line_no").distinct()


def p4_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of repeated lines that stand together on a site, with the number of documents they span."""
    return repeatedlines.repeated_blocks(_read(spark, folder, "chunks"))


def p4_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk text without the lines repeated on its site."""
    return repeatedlines.without_repeated(_read(spark, folder, "chunks"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.flag_pairs(_read(spark, folder, "query_responses")).select("response_id", "defect").distinct()


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Training sequences of 2,048 tokens: where each document, or piece of a longer one, goes."""
    return packing.fill_containers(_read(spark, folder, "documents"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return packing.cut_documents(p6_containers(spark, folder))


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the mixture, with the number of times each is used."""
    return mixing.mix(_read(spark, folder, "documents"), _read(spark, folder, "mix_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Per listed source its budget and the share it really reaches."""
    return mixing.mixture_report(_read(spark, folder, "documents"), _read(spark, folder, "mix_targets"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of which the mixture holds every document as often as it may, and which still miss their target."""
    return p7_shares(spark, folder).where("reached_tokens >= max_repeats * own_tokens and reached_tokens < target_tokens").select("source").distinct()


def p8_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics, line-kind shares and kind of every document."""
    return textkinds.text_statistics(_read(spark, folder, "documents"), _read(spark, folder, "common_words"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_statistics(spark, folder).where("kind <> 'prose'").select("doc_id", "kind").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_groups, p1_found, p2_pieces, p2_found, p3_neighbours, p3_found, p4_found, p4_blocks, p4_cleaned, p5_found, p6_containers, p6_found, p7_mixture, p7_shares, p7_found, p8_statistics, p8_found)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
