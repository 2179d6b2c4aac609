"""References between chunks, answers and labels: keys of articles and sections, cited chunks, urls, evaluation labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx


def _first(*parts: Column) -> Column:
    """The first part that is not null or empty."""
    return F.coalesce(*(F.when(p != "", p) for p in parts))


def article_key(url: Column, extra: Column, article: Column, name: Column, id_: Column) -> Column:
    """What groups the chunks of one article: its url, the source or document url in its extra fields, article:id, the document's name, the chunk's id."""
    e = lambda k: extra[k]
    mark = lambda c: F.concat(F.lit("article:"), F.when(c != "", c))
    return F.coalesce(_first(url, e("url"), e("source_url"), e("doc_url")), mark(article), mark(e("article_id")), _first(name), id_)


def section_key(article: Column, section: Column, subsection: Column, kind: Column) -> Column:
    """article::section, or the subsection or kind of section where it has none."""
    return F.concat(article, F.lit("::"), F.coalesce(_first(section, subsection, kind), F.lit("")))


def citation_details(used: DataFrame, chunks: DataFrame, by: str = "response_id") -> DataFrame:
    """(by, place, id, title, url, section, breadcrumb, article_id) of used chunks (by, place, id); ids without a chunk fall out."""
    e = lambda k: F.col("extra")[k]
    none = F.lit("")
    return used.join(chunks, "id").select(
        by, "place", "id",
        F.coalesce(_first(F.col("title")), F.col("doc_name"), none).alias("title"),
        F.coalesce(_first(F.col("url"), e("source_url")), e("url"), none).alias("url"),
        F.coalesce("section", none).alias("section"),
        F.coalesce("breadcrumb", none).alias("breadcrumb"),
        F.coalesce(_first(F.col("article_id")), e("article_id"), none).alias("article_id"),
    )


def match_sources(named: DataFrame, context: DataFrame, by: str) -> DataFrame:
    """(by, source, url): the context url (by, place, url) that each named source (by, source) stands for.

    Urls are compared without fragment and trailing slashes in lower case: an
    equal one wins, else the first in order of place that contains the source
    or is contained in it; sources without a match fall out. The join is by
    `by`, so a source meets its own context only.
    """
    keyed = context.where(F.col("url").isNotNull()).select(by, "place", F.trim("url").alias("url"), tx.url_key(F.col("url")).alias("k")).where("k <> ''")
    first = keyed.groupBy(by, "k").agg(F.min(F.struct("place", "url")).alias("s")).select(by, F.col("k").alias("_k"), "s.place", "s.url")
    both = named.withColumn("k", tx.url_key(F.col("source"))).join(first, by)
    same = F.col("k") == F.col("_k")
    both = both.where(same | ((F.col("k") != "") & (F.col("_k").contains(F.col("k")) | F.col("k").contains(F.col("_k")))))
    best = both.groupBy(by, "source").agg(F.min(F.struct(F.when(same, 0).otherwise(1).alias("far"), "place", "url")).alias("s"))
    return best.select(by, "source", "s.url")


def resolve_labels(labels: DataFrame, chunks: DataFrame, query_key: str = "query_id") -> DataFrame:
    """(query_key, id): the chunks (id, title, section) that labels (query_key, chunk_id, title, section) mean.

    A label with an id means the chunk of that id, if there is one. A label
    by title and section means all chunks of both, in lower case with single
    spaces; where there is none, or no section, all chunks of the title.
    """
    by_id = labels.where("chunk_id is not null").select(query_key, F.col("chunk_id").alias("id")).join(chunks.select("id"), "id", "left_semi").select(query_key, "id")
    key = lambda c: tx.match_key(F.coalesce(c, F.lit("")))
    keyed = chunks.select("id", key(F.col("title")).alias("t"), key(F.col("section")).alias("s"))
    asked = labels.where("title is not null").select(query_key, key(F.col("title")).alias("t"), key(F.col("section")).alias("s")).distinct()
    whole = asked.where("s <> ''").join(keyed, ["t", "s"]).select(query_key, "t", "s", "id")
    left = asked.join(whole.select(query_key, "t", "s").distinct(), [query_key, "t", "s"], "left_anti")
    titled = left.select(query_key, "t").join(keyed.select("id", "t"), "t")
    return by_id.union(whole.select(query_key, "id")).union(titled.select(query_key, "id")).distinct()


def one_row(chunks: DataFrame, *more: str) -> DataFrame:
    """One row an id of a chunk table, always the same one of several: the smallest in title, section, subsection, url, article and places, with its article and section key and the columns `more`."""
    m = F.col("metadata")
    order = F.struct(*(F.coalesce(c, F.lit("")) for c in ("title", "section", "subsection", "url", "article_id", "doc_name")), F.coalesce("section_idx", F.lit(-1)), F.coalesce("chunk_idx", F.lit(-1)), F.coalesce(m["section_type"], F.lit("")), F.coalesce(m["breadcrumb"], F.lit("")), F.coalesce(m["is_hub"], F.lit(False)))
    row = F.struct("title", "section", "subsection", "url", "article_id", "doc_name", "section_idx", "chunk_idx", m["section_type"].alias("section_type"), m["breadcrumb"].alias("breadcrumb"), F.coalesce(m["is_hub"], F.lit(False)).alias("hub"), m["extra"].alias("extra"))
    extra = [F.max(c).alias(c) for c in more]
    rows = chunks.where("id is not null").groupBy("id").agg(F.min_by(row, order).alias("r"), *extra).select("id", "r.*", *more)
    rows = rows.withColumn("article_key", article_key(F.col("url"), F.col("extra"), F.col("article_id"), F.col("doc_name"), F.col("id")))
    return rows.withColumn("section_key", section_key(F.col("article_key"), F.col("section"), F.col("subsection"), F.col("section_type")))
