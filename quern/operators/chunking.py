"""Articles, sections and chunks from marked-up documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as tx


def character_windows(df: DataFrame, key: str, text: str, size: int = 1600, overlap: int = 200) -> DataFrame:
    """(key, window, start, piece): windows of `size` characters that overlap by `overlap`, trimmed; blank ones, and null and blank texts, give no row."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    n = F.length(text)
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - overlap) / F.lit(size - overlap)) - 1).cast("int")
    rows = df.where(F.col(text).isNotNull() & (n > 0)).select(key, text, F.explode(F.sequence(F.lit(0), last)).alias("window"))
    start = F.col("window") * (size - overlap)
    return rows.select(key, "window", start.alias("start"), tx.stripped(F.substring(F.col(text), start + 1, F.lit(size))).alias("piece")).where("piece <> ''")


def chunk_id(name: Column, section: Column, chunk: Column, text: Column) -> Column:
    """name_section_chunk_digest, the digest being the first eight hex digits of the text's sha1."""
    return F.concat_ws("_", tx.slug(name), section.cast("string"), chunk.cast("string"), F.left(F.sha1(text), F.lit(8)))


def articles(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, article, title, url, body, meta): the articles of each document.

    Front-matter blocks (between lines of ---) give one article each, without
    those marked suppress_from_rag; else `# [ARTICLE] title` markers do, with
    a url on the next line where it starts with http; else the whole text is
    one article. `meta` holds the front matter as text.
    """
    block = r"(?sm)^---[ \t]*\n(.*?)\n---[ \t]*\n(.*?)(?=^---[ \t]*\n|\z)"
    t = F.regexp_replace(F.col(text), "\r\n?", "\n")
    rows = docs.where(F.col(text).isNotNull()).select(F.col(path).alias("path"), t.alias("t")).withColumn("front", F.regexp_extract_all("t", F.lit(block), F.lit(0)))
    front = rows.where(F.size("front") > 0).select("path", F.posexplode("front").alias("article", "b"))
    front = front.select("path", "article", F.regexp_extract("b", block, 1).alias("head"), F.regexp_extract("b", block, 2).alias("body"))
    front = front.mapInArrow(_front_matter, "path string, article int, body string, meta map<string,string>")
    front = front.where(F.coalesce(F.lower(F.col("meta")["suppress_from_rag"]), F.lit("false")) != "true")
    front = front.select("path", "article", F.coalesce(F.col("meta")["title"], F.lit("KB")).alias("title"), F.coalesce(F.col("meta")["source_url"], F.col("meta")["url"]).alias("url"), tx.fold_blanks(F.col("body")).alias("body"), "meta")
    marked = rows.where((F.size("front") == 0) & F.col("t").rlike(r"(?m)^# \[ARTICLE\]"))
    parts = F.filter(F.split("t", r"(?m)(?=^# \[ARTICLE\])"), lambda p: p.startswith("# [ARTICLE]"))
    marked = marked.select("path", F.posexplode(parts).alias("article", "p"))
    url = F.regexp_extract("p", r"^[^\n]*\n(http\S*)", 1)
    marked = marked.select("path", "article", F.trim(F.regexp_extract("p", r"^# \[ARTICLE\]([^\n]*)", 1)).alias("title"), F.when(url != "", url).alias("url"), F.regexp_replace("p", r"^[^\n]*\n?(?:http\S*[ \t]*\n?)?", "").alias("body"))
    whole = rows.where((F.size("front") == 0) & ~F.col("t").rlike(r"(?m)^# \[ARTICLE\]")).select("path", F.lit(0).alias("article"), F.lit("KB").alias("title"), F.lit(None).cast("string").alias("url"), F.col("t").alias("body"))
    none = F.create_map().cast("map<string,string>")
    return front.unionByName(marked.unionByName(whole).withColumn("meta", none))


def read_front_matter(block: str) -> dict[str, str]:
    """Keys and values of a front-matter block: scalars without quotes, lists (inline or of items) joined by commas; comments are skipped and the last of equal keys wins."""
    out: dict[str, str] = {}
    key = None
    for line in block.split("\n"):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if (item := re.match(r"\s*-\s+(.*)", line)) and key is not None:
            value = item[1].strip().strip("'\"")
            out[key] = f"{out[key]},{value}" if out.get(key) else value
        elif pair := re.match(r"([A-Za-z0-9_\-]+)\s*:\s*(.*)$", line.strip()):
            key, value = pair[1], pair[2].strip()
            if value.startswith("[") and value.endswith("]"):
                value = ",".join(v.strip().strip("'\"") for v in value[1:-1].split(",") if v.strip())
            out[key] = value.strip("'\"")
    return out


def _front_matter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        meta = [list(read_front_matter(h or "").items()) for h in batch.column("head").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("article"), batch.column("body"), pa.array(meta, pa.map_(pa.string(), pa.string()))], ["path", "article", "body", "meta"])


# What starts a new unit of a text (a blank line, a bullet, a numbered item, a heading below the first level), and the sections that matter most.
UNIT = r"(?U)(\n\s*\n|\n\s*[-*]\s+|\n\s*\d+\.\s+|\n#{2,}\s+)"
IMPORTANT = ("key points", "limits & gotchas", "canonical answer")
#: No character of any text: stands before the start of a unit.
_MARK = "\uffff"
_NONE = "array<string>"


def _texts(*parts: Column) -> Column:
    return F.array(*parts).cast(_NONE)


def _whole(parts: Column) -> Column:
    """Stripped parts, blank ones left out."""
    return F.filter(F.transform(parts, tx.stripped), lambda x: x != "")


def _windows(text: Column, size: int, overlap: int) -> Column:
    """The windows of `character_windows` as an array."""
    last = F.when(F.length(text) <= size, F.lit(0)).otherwise(F.ceil((F.length(text) - overlap) / F.lit(size - overlap)) - 1).cast("int")
    return _whole(F.transform(F.sequence(F.lit(0), last), lambda w: F.substring(text, w * (size - overlap) + 1, F.lit(size))))


def packed_units(text: Column, size: int) -> Column:
    """Units of a text put together in order, as many to a piece as fit; a longer unit is a piece of its own. A unit holds the separator it starts with."""
    units = F.filter(F.split(F.regexp_replace(text, UNIT, _MARK + "$1"), _MARK), lambda u: tx.stripped(u) != "")

    def add(state: Column, unit: Column) -> Column:
        full = (state["now"] != "") & (F.length(state["now"]) + F.length(unit) > size)
        return F.struct(F.when(full, F.array_append(state["done"], state["now"])).otherwise(state["done"]).alias("done"), F.when(full, unit).otherwise(F.concat(state["now"], unit)).alias("now"))

    return F.aggregate(units, F.struct(_texts().alias("done"), F.lit("").alias("now")), add, lambda state: _whole(F.array_append(state["done"], state["now"])))


def packed_sentences(text: Column, size: int, overlap: int) -> Column:
    """Sentences (cut after . ! ? before white space) put together with single spaces, as many to a piece as fit; a piece starts with the last sentences of the one before that fit in `overlap` and leave room. Longer sentences are cut into windows."""
    line = lambda parts: F.array_join(parts, " ")
    close = lambda state: F.when(F.size(state["now"]) > 0, F.array_append(state["done"], line(state["now"]))).otherwise(state["done"])

    def tail(now: Column, sentence: Column) -> Column:
        def keep(state: Column, x: Column) -> Column:
            n = state["n"] + F.length(x)
            fits = state["open"] & (n <= overlap) & (n + 1 + F.length(sentence) <= size)
            return F.struct(F.when(fits, F.array_prepend(state["kept"], x)).otherwise(state["kept"]).alias("kept"), F.when(fits, n + 1).otherwise(state["n"]).alias("n"), fits.alias("open"))

        return F.aggregate(F.reverse(now), F.struct(_texts().alias("kept"), F.lit(0).alias("n"), F.lit(True).alias("open")), keep, lambda state: state["kept"])

    def add(state: Column, sentence: Column) -> Column:
        long = F.length(sentence) > size
        full = (F.size(state["now"]) > 0) & (F.length(line(state["now"])) + 1 + F.length(sentence) > size)
        done = F.when(long, F.concat(close(state), _windows(sentence, size, overlap))).when(full, close(state)).otherwise(state["done"])
        now = F.when(long, _texts()).when(full, F.array_append(tail(state["now"], sentence), sentence)).otherwise(F.array_append(state["now"], sentence))
        return F.struct(done.alias("done"), now.alias("now"))

    sentences = F.filter(F.split(text, r"(?U)(?<=[.!?])\s+"), lambda x: x != "")
    return F.aggregate(sentences, F.struct(_texts().alias("done"), _texts().alias("now")), add, lambda state: _whole(close(state)))


def boundary_pieces(text: Column, size: int = 1600, overlap: int = 200, sentences: bool = True) -> Column:
    """A text's pieces of at most `size` characters, as an array; a text within `size` is one piece as it is.

    Longer ones lose noise (`text.without_noise`) and runs of blanks, come in
    NFKC and are packed from units; a unit over `size` is packed from
    sentences, or, without `sentences`, cut into windows. Null and blank texts
    have no pieces. Nothing leaves the row: no shuffle, and an array lives as
    long as its row.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    plain = F.regexp_replace(tx.nfkc(tx.without_noise(text)), "[ \t]+", " ")
    cut = lambda p: F.when(F.length(p) <= size, _texts(p)).otherwise(packed_sentences(p, size, overlap) if sentences else _windows(p, size, overlap))
    return F.when(F.coalesce(tx.stripped(text), F.lit("")) == "", _texts()).when(F.length(text) <= size, _texts(text)).otherwise(F.flatten(F.transform(packed_units(plain, size), cut)))


def importance(section: Column) -> Column:
    """high for the listed sections, medium where the label has faq in it, else null."""
    return F.when(F.lower(section).isin(*IMPORTANT), "high").when(F.lower(section).contains("faq"), "medium")


def build_chunks(docs: DataFrame, path: str = "path", text: str = "text", size: int = 1600, overlap: int = 200, sentences: bool = True, title_suffix: str = "") -> DataFrame:
    """Chunks of marked-up documents: id, article_id, title, url, section, subsection, text (after a context line), doc_path, doc_name, section_idx, chunk_idx, char_count, word_count and metadata.

    Documents are taken apart by nested explodes. A section's label is its
    first line without heading marks; the context line is title (without
    `title_suffix`), label and first subsection. Blank bodies have no chunks.
    The id ends in a digest of slug, places and text.
    """
    meta = lambda k: F.when(F.col("meta")[k] != "", F.col("meta")[k])
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]+$", "")
    a = articles(docs, path, text).withColumn("doc_name", stem)
    a = a.withColumn("article_id", F.trim(F.coalesce(meta("id"), meta("slug"), "doc_name"))).withColumn("slug", tx.slug(F.coalesce(meta("slug"), "article_id")))
    a = a.withColumn("slug", F.when(F.col("slug") != "", F.col("slug")).otherwise(F.col("doc_name")))
    a = a.select("path", "doc_name", "article_id", "slug", tx.collapsed(F.coalesce(meta("short_title"), meta("title"), "title")).alias("title"), "url", F.posexplode(tx.sections(F.col("body"))).alias("section_idx", "body"))
    a = a.withColumn("section", tx.collapsed(F.regexp_replace(F.regexp_extract("body", r"^([^\n]*)", 1), r"^#+\s*", ""))).withColumn("subsection", F.coalesce(F.try_element_at(tx.subheadings(F.col("body")), F.lit(1)), F.lit("")))
    bare = F.trim(F.replace("title", F.lit(title_suffix), F.lit(""))) if title_suffix else F.col("title")
    label = F.when(F.lower("section") != F.lower(bare), F.col("section"))
    crumb = F.array_join(F.filter(F.array(bare, F.coalesce(label, F.lit("")), "subsection"), lambda x: x != ""), " > ")
    rows = a.withColumn("breadcrumb", crumb).select("*", F.posexplode(boundary_pieces(F.col("body"), size, overlap, sentences)).alias("chunk_idx", "piece"))
    rows = rows.withColumn("text", F.when(F.col("breadcrumb") != "", F.concat(F.lit("Context: "), "breadcrumb", F.lit("\n\n"), "piece")).otherwise(F.col("piece")))
    digest = F.left(F.sha1(F.concat_ws("|", "slug", F.col("section_idx").cast("string"), F.col("chunk_idx").cast("string"), "text")), F.lit(8))
    found = tx.metadata(F.col("piece"))
    about = F.struct(found["dates"].alias("dates"), found["urls"].alias("urls"), found["emails"].alias("emails"), "slug", F.when(F.col("section") != "", F.col("section")).alias("section_type"), importance(F.col("section")).alias("section_importance"), "breadcrumb")
    return rows.select(
        F.concat_ws("_", "slug", F.col("section_idx").cast("string"), F.col("chunk_idx").cast("string"), digest).alias("id"), "article_id", "title", "url", "section", "subsection", "text",
        F.col("path").alias("doc_path"), "doc_name", "section_idx", "chunk_idx", F.length("text").alias("char_count"), F.size(F.split(tx.collapsed(F.col("text")), " ")).alias("word_count"), about.alias("metadata"),
    )
