"""Lexical retrieval over chunk tables: BM25 statistics, scores and top lists, query expansion, keyword overlap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.functions.text import collapsed, terms
from quern.plans.session import cut_lineage

K1, B = 1.2, 0.65
#: Rows of a table of questions (terms) up to which it is broadcast.
BROADCAST_ROWS = 50_000
#: Terms of all queries together up to which documents are reduced to them while they are read, and scored in blocks.
PAIRS = 20_000
#: Keywords and phrases, of all questions together, that are looked for in every chunk.
PATTERNS = 20_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint where it has at most `rows` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): how often each term occurs in each document."""
    return docs.select(key, F.explode(terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def term_statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, df, idf) over all documents. Terms are made distinct per document first, so no (document, term) table is shuffled."""
    corpus = docs.agg(F.count("*").alias("n"))
    df = docs.select(F.explode(F.array_distinct(terms(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(corpus)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def held_terms(docs: DataFrame, key: str, text: str, wanted: list[str] | None = None) -> DataFrame:
    """(key, dl, held): per key the number of its terms, and those of them that are wanted (all without a list), written once.

    Texts are read and taken apart once and never shuffled; of several rows of
    a key the text with the largest md5 counts, so copies count once.
    """
    rows = docs.select(key, F.coalesce(F.md5(text), F.lit("")).alias("digest"), terms(F.col(text)).alias("terms"))
    held = F.col("terms") if wanted is None else F.filter("terms", lambda t: t.isin(*wanted)) if wanted else F.array().cast("array<string>")
    rows = rows.select(key, "digest", F.struct(F.size("terms").alias("dl"), held.alias("held")).alias("s"))
    return cut_lineage(rows.groupBy(key).agg(F.max_by("s", "digest").alias("s")).select(key, "s.dl", "s.held"))


def bm25(queries: DataFrame, docs: DataFrame, query_key: str = "query_id", query: str = "query", key: str = "id", text: str = "text", k1: float = K1, b: float = B, keep: int | None = None) -> DataFrame:
    """(query_key, key, bm25) of every query and document with a term in common; with `keep` a batch gives only what can be among a query's `keep` best.

    The documents are read once: only their terms that a query asks for, and
    their length, go on. Up to PAIRS terms of queries the scores are block
    products, documents' term counts times term weights; more are joined by
    term. Document frequencies are needed for those terms only. A term that a
    query repeats counts as often. Documents may come in several rows of one
    text.
    """
    asked = cut_lineage(queries.select(query_key, F.explode(terms(F.col(query))).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("qtf")))
    pairs = asked.limit(PAIRS + 1).collect()
    few = len(pairs) <= PAIRS
    sized = held_terms(docs, key, text, sorted({r.term for r in pairs}) if few else None)
    corpus = sized.agg(F.count("*").alias("n"), (F.sum("dl") / F.greatest(F.count("*"), F.lit(1))).alias("avgdl"))
    frequent = sized.select(F.explode(F.array_distinct("held")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    if few:
        found = {r.term: r.df for r in frequent.collect()}
        n, avgdl = corpus.first()
        kinds = dict(queries.select(query_key).dtypes) | dict(docs.select(key).dtypes)
        weights = [(r[0], r.term, r.qtf * math.log((n - found[r.term] + 0.5) / (found[r.term] + 0.5) + 1)) for r in pairs if r.term in found]
        types = [to_arrow_type(queries.schema[query_key].dataType)]
        rows = sized.select(F.col(key).alias("key"), "dl", "held").where(F.size("held") > 0)
        rows = rows.mapInArrow(lambda it: _weighed(it, weights, types[0], max(1.0, avgdl or 1.0), k1, b, keep), f"q {kinds[query_key]}, key {kinds[key]}, bm25 double")
        return rows.select(F.col("q").alias(query_key), F.col("key").alias(key), "bm25")
    held = sized.select(key, "dl", F.explode("held").alias("term")).groupBy(key, "term", "dl").agg(F.count("*").alias("tf"))
    weights = asked.join(frequent, "term").crossJoin(F.broadcast(corpus)).select(query_key, "term", "qtf", idf(F.col("n"), F.col("df")).alias("idf"), "avgdl")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.greatest(F.lit(1.0), F.col("avgdl"))))
    return held.join(weights, "term").groupBy(query_key, key).agg(F.sum(part).alias("bm25"))


def _weighed(batches: Iterator[pa.RecordBatch], weights: list[tuple], kind: pa.DataType, avgdl: float, k1: float, b: float, keep: int | None) -> Iterator[pa.RecordBatch]:
    """Scores of a batch's documents for all queries: the documents' saturated term counts times the weights of the terms."""
    names = sorted({t for _, t, _ in weights})
    asked = sorted({q for q, _, _ in weights})
    place, number = {t: i for i, t in enumerate(names)}, {q: i for i, q in enumerate(asked)}
    matrix = np.zeros((len(names), len(asked)))
    for q, t, w in weights:
        matrix[place[t], number[q]] = w
    keys = pa.array(asked, kind)
    listed = pa.array(names, pa.string())
    for whole in batches:
        for start in range(0, whole.num_rows, 2048):
            batch = whole.slice(start, 2048)
            held = batch.column("held")
            size = pc.list_value_length(held).to_numpy(zero_copy_only=False)
            term = pc.index_in(pc.list_flatten(held), listed).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(batch.num_rows), size)
            tf = np.bincount(doc * len(names) + term, minlength=batch.num_rows * len(names)).reshape(batch.num_rows, -1).astype(float)
            dl = batch.column("dl").to_numpy()[:, None]
            score = (tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))) @ matrix
            least = np.full(score.shape[1], 0.0)
            if keep is not None and len(score) > keep:
                least = np.maximum(0.0, np.partition(score, len(score) - keep, axis=0)[len(score) - keep] - 1e-9)
            row, column = np.nonzero((score > 0) & (score >= least))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(column)), batch.column("key").take(pa.array(row)), pa.array(score[row, column])], ["q", "key", "bm25"])


def okapi(queries: DataFrame, docs: DataFrame, query_key: str = "query_id", query: str = "query", key: str = "id", text: str = "text", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(query_key, key, score): BM25 in its Okapi form, in which terms of more than half of all documents weigh `epsilon` times the mean idf of the vocabulary instead of a negative idf."""
    asked = queries.select(query_key, F.explode(terms(F.col(query))).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("qtf"))
    sized = held_terms(docs, key, text)
    corpus = sized.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    frequent = sized.select(F.explode(F.array_distinct("held")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = cut_lineage(frequent.crossJoin(F.broadcast(corpus)).select("term", "avgdl", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf")))
    floor = weights.agg((F.avg("idf") * epsilon).alias("floor"))
    weights = weights.join(small(asked.select("term").distinct()), "term").crossJoin(F.broadcast(floor)).withColumn("idf", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")))
    weights = asked.join(weights, "term")
    held = sized.select(key, "dl", F.explode("held").alias("term")).join(small(asked.select("term").distinct()), "term").groupBy(key, "term", "dl").agg(F.count("*").alias("tf"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return held.join(small(weights), "term").groupBy(query_key, key).agg(F.sum(part).alias("score"))


def top(scores: DataFrame, k: int, score: str, query_key: str = "query_id", key: str = "id", rank: str = "rank") -> DataFrame:
    """The k best rows of each query, ties by key, with their rank from 1; each task keeps only its own k best before the shuffle."""
    order = Window.partitionBy(query_key).orderBy(F.desc(score), F.col(key))
    return scores.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def expand(queries: DataFrame, synonyms: DataFrame, query_key: str = "query_id", query: str = "query", most: int = 20_000) -> DataFrame:
    """queries with `expanded`: the query with single spaces, followed by the synonyms (place, term, ord, synonym) of its terms, each once, in the order of the dictionary, cut to `most` characters at a space."""
    words = queries.select(query_key, F.explode(F.array_distinct(terms(F.col(query)))).alias("term"))
    listed = F.array_sort(F.collect_list(F.struct("place", "ord", "synonym")))
    found = words.join(small(synonyms), "term").groupBy(query_key).agg(F.array_distinct(F.transform(listed, lambda s: s["synonym"])).alias("more"))
    plain = collapsed(F.col(query))
    more = F.array_join(F.coalesce("more", F.array().cast("array<string>")), " ")
    room = F.lit(most) - F.length(plain) - 1
    fits = F.when(F.length(more) <= room, more).otherwise(F.trim(F.regexp_replace(F.left(more, F.greatest(room, F.lit(0))), r" [^ ]*$", "")))
    return queries.join(found, query_key, "left").withColumn("expanded", F.when((fits == "") | (room <= 0), plain).otherwise(F.concat(plain, F.lit(" "), fits))).drop("more")


def keyword_overlap(queries: DataFrame, docs: DataFrame, query_key: str = "query_id", query: str = "query", key: str = "id", text: str = "text") -> DataFrame:
    """(query_key, key, overlap): number of distinct terms a query and a document have in common."""
    asked = small(queries.select(query_key, F.explode(F.array_distinct(terms(F.col(query)))).alias("term")))
    return docs.select(key, F.explode(F.array_distinct(terms(F.col(text)))).alias("term")).join(asked, "term").groupBy(query_key, key).agg(F.count("*").alias("overlap"))


def patterns_of(questions: DataFrame, stop: tuple[str, ...], query_key: str = "query_id", most_words: int = 4) -> DataFrame:
    """(query_key, pattern, words, times): the keywords (words = 1) and phrases of a question, its tags and notes.

    Keywords are terms of more than two characters that are no stop words,
    as often as they occur; phrases are runs of two to `most_words` terms of
    one field without its stop words, of more than three characters, once each.
    """
    fields = F.filter(F.concat(F.array("query"), F.coalesce("tags", F.array().cast("array<string>")), F.array("notes")), lambda f: f.isNotNull())
    rows = questions.select(query_key, F.explode(F.transform(fields, lambda f: terms(f))).alias("t"))
    keywords = rows.select(query_key, F.explode("t").alias("pattern")).where((F.length("pattern") > 2) & ~F.col("pattern").isin(*stop))
    keywords = keywords.groupBy(query_key, "pattern").agg(F.count("*").alias("times")).select(query_key, "pattern", F.lit(1).alias("words"), "times")
    bare = rows.select(query_key, F.filter("t", lambda w: ~w.isin(*stop)).alias("t"))

    def runs(n: int) -> Column:
        starts = F.when(F.size("t") >= n, F.sequence(F.lit(1), F.size("t") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice("t", i, F.lit(n)), " "))

    phrases = bare.select(query_key, F.explode(F.concat(*(runs(n) for n in range(2, most_words + 1)))).alias("pattern")).where(F.length("pattern") > 3).distinct()
    return keywords.union(phrases.select(query_key, "pattern", F.size(F.split("pattern", " ")), F.lit(1).cast("bigint")))


def heuristic_relevance(questions: DataFrame, docs: DataFrame, stop: tuple[str, ...], query_key: str = "query_id", key: str = "id") -> DataFrame:
    """(query_key, key, score) of the documents (title, section, url, text) that hold a keyword or phrase of a question.

    A keyword counts 3 for title, section and url, 1.5 for the text and 0.5
    where it is part of any of them, all three together, times its number;
    a phrase that is part of them counts 1 and a quarter for each of its words. All patterns of all
    questions, at most PATTERNS, are looked for while a document is read.
    """
    found = patterns_of(questions, stop, query_key)
    listed = [r.pattern for r in found.select("pattern").distinct().limit(PATTERNS + 1).collect()]
    if len(listed) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} patterns; split the questions")
    if not listed:
        return found.join(docs.select(key).limit(0)).select(query_key, key, F.lit(0.0).alias("score"))
    label = F.array_distinct(terms(F.concat_ws(" ", "title", "section", "url")))
    blob = F.lower(F.concat_ws(" ", *(F.when(F.col(c) != "", F.col(c)) for c in ("title", "section", "url", "text"))))
    rows = docs.select(key, label.alias("label"), F.array_distinct(terms(F.col("text"))).alias("body"), blob.alias("blob"))
    patterns = F.array(*(F.lit(x) for x in sorted(listed)))
    held = F.transform(F.array("blob"), lambda b: F.filter(patterns, lambda x: b.contains(x)))[0]  # as a lambda's variable the text is put together once
    rows = rows.select(key, "label", "body", held.alias("held"))
    one = rows.select(key, F.explode("held").alias("pattern"), "label", "body")
    one = one.select(key, "pattern", (F.array_contains("label", F.col("pattern")).cast("int") * 3.0 + F.array_contains("body", F.col("pattern")).cast("int") * 1.5 + 0.5).alias("weight"))
    score = F.when(F.col("words") == 1, F.col("weight") * F.col("times")).otherwise(1.0 + 0.25 * F.col("words"))
    return one.join(F.broadcast(found), "pattern").groupBy(query_key, key).agg(F.sum(score).alias("score"))
