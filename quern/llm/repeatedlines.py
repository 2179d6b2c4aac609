"""Lines repeated across one site's documents, found by suffix arrays over line identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.session import cut_lineage

#: Numbers (line identifiers) in a table up to which it is broadcast, 16 MB; beyond that it is joined by shuffle.
BROADCAST_NUMBERS = 2_000_000
#: Most lines of a block: a suffix is compared by so many of its lines, so the suffixes of a document take space in proportion to its lines.
LONGEST = 64


def site_of(url: Column) -> Column:
    """The host of a url in lower case, without port and leading www.; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(?:www\.)?([^/?#:\s]+)", 1)
    return F.when(host != "", host)


def line_ids(text: Column) -> Column:
    """A hash per line (between \\n), null for blank ones; lines are compared trimmed, with single spaces, in lower case."""
    spaced = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[\s&&[^\n]]+", " "), " ?\n ?", "\n")), "\n")
    return F.transform(spaced, lambda x: F.when(x != "", F.xxhash64(x)))


def _documents(df: DataFrame, key: str, text: str, url: str) -> DataFrame:
    """(id, site, lines), several texts under one id and site a row each; written once, without the texts."""
    rows = df.select(F.col(key).cast("string").alias("id"), site_of(F.col(url)).alias("site"), F.coalesce(line_ids(F.col(text)), F.array().cast("array<bigint>")).alias("lines"))
    rows = rows.where("id is not null and site is not null").withColumn("version", F.xxhash64("lines"))
    return cut_lineage(rows.groupBy("id", "site", "version").agg(F.first("lines").alias("lines")))


def _small(df: DataFrame, numbers: Column) -> DataFrame:
    """df with a broadcast hint where it holds few numbers."""
    held = df.agg(F.sum(numbers)).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST_NUMBERS else df


def _repeated(docs: DataFrame, least: int, share: float) -> DataFrame:
    """(site, line, documents): the lines in at least `least` of a site's documents and in at least `share` of them.

    This is the first level of the site's suffix array: suffixes bucketed by
    their first line, each bucket counted in documents. A line counts once an
    id, and partial counts are made before the shuffle, so a line of a third
    of all rows is no hot spot. At most (1 / share) x lines per document
    remain for a site.
    """
    twice = docs.groupBy("id", "site").agg(F.count("*").alias("n"), F.min("version").alias("version")).where("n > 1").drop("n")
    if twice.limit(1).count():
        once = docs.join(twice.select("id", "site", F.col("version").alias("_v")), ["id", "site"], "left")
        several = once.where("_v is not null").groupBy("id", "site").agg(F.flatten(F.collect_list("lines")).alias("lines"))
        docs = once.where("_v is null").select("site", "lines").union(several.select("site", "lines"))
    lines = docs.select("site", F.explode(F.concat(F.filter(F.array_distinct("lines"), lambda x: x.isNotNull()), F.array(F.lit(None).cast("bigint")))).alias("line"))  # a null line counts the site's documents
    counts = lines.groupBy("site", "line").agg(F.count("*").alias("documents")).where((F.col("documents") >= least) | F.col("line").isNull())
    counts = cut_lineage(counts)
    sites = counts.where("line is null").select("site", F.col("documents").alias("of"))
    return counts.where("line is not null").join(sites, "site").where(F.col("documents") >= F.lit(share) * F.col("of") - 1e-9).select("site", "line", "documents")


def _runs(docs: DataFrame, least: int, share: float) -> DataFrame:
    """(site, id, version, seq, at): the stretches of repeated lines of a document, blank lines aside, with their line numbers. The suffixes of these are all that a repeated block can start with."""
    repeated = cut_lineage(_repeated(docs, least, share)).select("site", "line")
    filled = F.filter(F.transform("lines", lambda x, i: F.struct((i + 1).cast("bigint").alias("at"), x.alias("line"))), lambda s: s["line"].isNotNull())
    lines = docs.select("id", "site", "version", F.posexplode(filled).alias("k", "p")).select("id", "site", "version", "k", "p.at", "p.line")
    hit = lines.join(_small(repeated, F.lit(1)), ["site", "line"])
    # a document's lines stay together from here: one shuffle for numbering and collecting
    hit = hit.groupBy("site", "id", "version").agg(F.array_sort(F.collect_list(F.struct("k", "line", "at"))).alias("h"))
    run = hit.select("site", "id", "version", F.posexplode("h").alias("i", "x")).select("site", "id", "version", "x", (F.col("x.k") - F.col("i")).alias("run"))
    rows = run.groupBy("site", "id", "version", "run").agg(F.array_sort(F.collect_list("x")).alias("r"))
    return cut_lineage(rows.select("site", "id", "version", F.col("r.line").alias("seq"), F.col("r.at").alias("at")))


def _suffixes(rows: DataFrame, *keep: str) -> DataFrame:
    """The suffixes of each stretch by their first LONGEST lines."""
    starts = F.explode(F.sequence(F.lit(1), F.size("seq"))).alias("start")
    return rows.select("site", "seq", *keep, starts).select("site", *keep, "start", F.slice("seq", F.col("start"), F.lit(LONGEST)).alias("suffix")).withColumn("first", F.col("suffix")[0])


def _blocks(runs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The repeated blocks of each site, and the places (site, id, version, at, start, lines) where documents hold them.

    Equal runs are merged with their counts, so the suffix array of a site is
    built over distinct runs. Suffixes are sorted within (site, first line);
    the common prefix of neighbours in that order is a block, and so is a
    suffix that occurs often by itself. The shortest common prefix of a
    bucket spans all of its documents.
    """
    kinds = runs.groupBy("site", "seq").agg(F.count("*").alias("n"))
    array = _suffixes(kinds, "n").groupBy("site", "first", "suffix").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("site", "first").orderBy("suffix")
    near = array.select("site", "suffix", "n", F.lag("suffix").over(order).alias("before"))
    differs = F.filter(F.transform(F.arrays_zip(F.col("suffix").alias("x"), F.col("before").alias("y")), lambda s, i: F.when(~s["x"].eqNullSafe(s["y"]), i)), lambda i: i.isNotNull())
    common = near.where("before is not null").select("site", F.slice("suffix", F.lit(1), F.coalesce(F.array_min(differs), F.size("suffix"))).alias("lines"))
    often = near.where(F.col("n") >= least).select("site", F.col("suffix").alias("lines"))
    found = cut_lineage(common.union(often).distinct().withColumn("first", F.col("lines")[0]))
    held = _suffixes(runs, "id", "version", "at").join(_small(found, F.size("lines")), ["site", "first"]).where(F.slice("suffix", F.lit(1), F.size("lines")) == F.col("lines"))
    blocks = held.groupBy("site", "lines").agg(F.countDistinct("id").alias("documents")).where(F.col("documents") >= least)
    return blocks, held


def repeated_blocks(df: DataFrame, key: str = "id", text: str = "text", url: str = "url", least: int = 5, share: float = 0.05) -> DataFrame:
    """(site, lines, length, documents): blocks of repeated lines that stand together in at least `least` documents of a site; `lines` are line identifiers. A stretch of more than LONGEST lines comes as blocks of LONGEST lines, one from each of its lines on."""
    blocks, _ = _blocks(_runs(_documents(df, key, text, url), least, share), least)
    return blocks.select("site", "lines", F.size("lines").alias("length"), "documents")


def _places(docs: DataFrame, least: int, share: float) -> DataFrame:
    """(id, site, version, at): per document the sorted numbers, from 1, of its lines that lie in a repeated block of its site."""
    blocks, held = _blocks(_runs(docs, least, share), least)
    blocks = cut_lineage(blocks.select("site", "lines"))
    places = held.join(_small(blocks, F.size("lines")), ["site", "lines"], "left_semi")
    longest = places.groupBy("site", "id", "version", "at", "start").agg(F.max(F.size("lines")).alias("length"))
    part = longest.select("id", "site", "version", F.slice("at", F.col("start"), F.col("length")).alias("at"))
    return part.groupBy("id", "site", "version").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"))


def repeated_places(df: DataFrame, key: str = "id", text: str = "text", url: str = "url", least: int = 5, share: float = 0.05) -> DataFrame:
    """(id, site, line_no): every line of a document, from 1, that lies in a repeated block of its site.

    Null keys, rows without a site and null texts give no row; rows that
    repeat a key count once, and several texts under one key are searched one
    by one; other columns are ignored.
    """
    places = _places(_documents(df, key, text, url), least, share)
    return places.select("id", "site", F.explode("at").alias("line_no")).distinct()


def without_repeated(df: DataFrame, key: str = "id", text: str = "text", url: str = "url", least: int = 5, share: float = 0.05) -> DataFrame:
    """(id, cleaned, removed): each row's text without the lines that lie in repeated blocks of its site, and how many went.

    Rows without a site, a key or a text keep what they have. One row per
    input row; other columns are ignored. Lines are cut where
    `repeated_places` finds them: texts are joined with these places by key
    and a hash of their lines, which is shuffled unless the places are few.
    """
    places = _places(_documents(df, key, text, url), least, share)
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("t"), F.col(key).cast("string").alias("_id"), site_of(F.col(url)).alias("_site"), F.xxhash64(F.coalesce(line_ids(F.col(text)), F.array().cast("array<bigint>"))).alias("_version"))
    cut = _small(cut_lineage(places.select(F.col("id").alias("_id"), F.col("site").alias("_site"), F.col("version").alias("_version"), "at")), F.size("at"))
    rows = rows.join(cut, ["_id", "_site", "_version"], "left")
    lines = F.split("t", "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains("at", (i + 1).cast("bigint")))
    cleaned = F.when(F.col("at").isNull() | F.col("t").isNull(), F.col("t")).otherwise(F.array_join(kept, "\n"))
    return rows.select("id", cleaned.alias("cleaned"), F.when(F.col("t").isNull(), F.lit(0)).otherwise(F.coalesce(F.size("at"), F.lit(0))).alias("removed"))
