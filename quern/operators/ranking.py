"""Score fusion and ranked-list operators: z-scores, hybrid fusion, deduplication, diversity, MMR, confidence, ranking quality."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import escaped
from quern.operators.lexical import top


def z_columns(scores: DataFrame, score: str, n: DataFrame | None = None, by: str = "query_id") -> DataFrame:
    """Per value of `by`: mean and population deviation of `score`.

    With `n`, a one-row table (n) of the corpus size, rows that are missing
    count as zeros: the moments come from the sums, and the zeros need no rows.
    """
    if n is None:
        return scores.groupBy(by).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("dev"))
    sums = scores.groupBy(by).agg(F.sum(score).alias("s1"), F.sum(F.col(score) * F.col(score)).alias("s2")).crossJoin(F.broadcast(n))
    mean = F.col("s1") / F.col("n")
    return sums.select(by, mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - mean * mean)).alias("dev"))


def z(score: Column, mean: Column, dev: Column) -> Column:
    """z-score; 0 where the deviation is 0 or nothing is known."""
    return F.coalesce(F.when(dev > 0, (score - mean) / dev), F.lit(0.0))


def fuse(lexical: DataFrame, candidates: DataFrame, moments: DataFrame, k: int, alpha: float = 0.5, factor: float = 1.0, query_key: str = "query_id", key: str = "id") -> DataFrame:
    """(query_key, key, bm25, dense, hybrid, rank): the k best by alpha z(bm25) + (1 - alpha) z(dense), times `factor` where `flag` holds (a hub page).

    `lexical` holds each query's 3k best lexical scores, others are 0 (as is
    every document without a term in common); `candidates` (query_key, key,
    flag, dense) those and each query's dense best of either flag: outside the
    lexical list documents of one flag differ by their dense score alone, so
    these are enough. `moments` (query_key, n, mean, dev) are of all dense
    scores; both z-scores are over the whole corpus of n.
    """
    sums = lexical.groupBy(query_key).agg(F.sum("bm25").alias("s1"), F.sum(F.col("bm25") * F.col("bm25")).alias("s2")).join(moments.select(query_key, "n"), query_key)
    mean = F.col("s1") / F.col("n")
    lex_stats = sums.select(query_key, mean.alias("lm"), F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - mean * mean)).alias("ls"))
    den_stats = moments.select(query_key, F.col("mean").alias("dm"), F.col("dev").alias("ds"))
    rows = candidates.join(lexical, [query_key, key], "left").join(den_stats, query_key).join(lex_stats, query_key, "left")
    score = alpha * z(F.coalesce("bm25", F.lit(0.0)), F.col("lm"), F.col("ls")) + (1 - alpha) * z(F.col("dense"), F.col("dm"), F.col("ds"))
    rows = rows.select(query_key, key, F.coalesce("bm25", F.lit(0.0)).alias("bm25"), "dense", F.round(F.when(F.col("flag"), score * factor).otherwise(score), 9).alias("hybrid"))
    return top(rows, k, "hybrid", query_key, key)


def first_of(rows: DataFrame, by: list[str], query_key: str = "query_id", rank: str = "rank") -> DataFrame:
    """Of each ranked list the first row of every value of `by`."""
    order = Window.partitionBy(query_key, *by).orderBy(rank)
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def diverse(rows: DataFrame, article: str = "article", section: str = "section", per_article: int = 2, per_section: int = 1, query_key: str = "query_id", rank: str = "rank") -> DataFrame:
    """At most per_section rows of a section, then at most per_article of an article, best ranks first; 0 sets no limit."""
    if per_section:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(query_key, article, section).orderBy(rank))).where(F.col("_n") <= per_section).drop("_n")
    if per_article:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(query_key, article).orderBy(rank))).where(F.col("_n") <= per_article).drop("_n")
    return rows


def marginal_relevance(rows: DataFrame, k: int = 10, weight: float = 0.75, query_key: str = "query_id", key: str = "id", relevance: str = "dense", vector: str = "embedding") -> DataFrame:
    """(query_key, key, pick): k rows of each short list, each picked for its relevance less its similarity to those picked before.

    The first has the highest relevance; ties go to the smaller key. Lists
    are expected to be cut to a top list before: a group is one query's list.
    """
    kinds = dict(rows.dtypes)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        x = np.array(pdf[vector].to_list(), np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        gain = pdf[relevance].to_numpy(np.float64)
        chosen: list[int] = []
        near = np.full(len(pdf), -np.inf)
        while len(chosen) < min(k, len(pdf)):
            value = gain.copy() if not chosen else weight * gain - (1 - weight) * near
            value[chosen] = -np.inf
            best = int(np.argmax(np.round(value, 12)))
            chosen.append(best)
            near = np.maximum(near, x @ x[best])
        return pd.DataFrame({query_key: pdf[query_key].iloc[chosen], key: pdf[key].iloc[chosen], "pick": np.arange(1, len(chosen) + 1)})

    return rows.select(query_key, key, relevance, vector).groupBy(query_key).applyInPandas(pick, f"`{query_key}` {kinds[query_key]}, `{key}` {kinds[key]}, pick int")


def confidence(rows: DataFrame, threshold: float = 0.25, query_key: str = "query_id", score: str = "hybrid") -> DataFrame:
    """(query_key, confidence): 0 to 100 from the scores of a ranked list, clipped to [0, 1].

    The best score sets the base, linear up to 40 below `threshold` and on to
    100 above it, cut to a whole number. In a list of two and more a mean over
    0.8 of the best adds 5 and one under half of it takes 10; then three and
    more scores at the threshold add 5, fewer than two take 10. Each step
    stays within 0 to 100.
    """
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score)))
    g = rows.groupBy(query_key).agg(F.max(s).alias("best"), F.avg(s).alias("mean"), F.count("*").alias("n"), F.count_if(s >= threshold).alias("good"))
    within = lambda x: F.greatest(F.lit(0), F.least(F.lit(100), x))
    base = F.when(F.col("best") < threshold, F.col("best") / threshold * 40).otherwise(40 + (F.col("best") - threshold) / (1 - threshold) * 60).cast("int")
    ratio = F.when(F.col("best") > 0, F.col("mean") / F.col("best")).otherwise(F.lit(0.0))
    g = g.select(query_key, "good", F.when(F.col("n") < 2, base).when(ratio > 0.8, within(base + 5)).when(ratio < 0.5, within(base - 10)).otherwise(base).alias("c"))
    return g.select(query_key, within(F.when(F.col("good") >= 3, within(F.col("c") + 5)).when(F.col("good") < 2, within(F.col("c") - 10)).otherwise(F.col("c"))).alias("confidence"))


def covered(rows: DataFrame, threshold: float = 0.25, least: int = 2, query_key: str = "query_id", score: str = "dense") -> DataFrame:
    """(query_key, n, good, covered): whether a list has at least `least` rows and two of them reach the threshold."""
    g = rows.groupBy(query_key).agg(F.count("*").alias("n"), F.count_if(F.col(score) >= threshold).alias("good"))
    return g.select(query_key, "n", "good", ((F.col("n") >= least) & (F.col("good") >= 2)).alias("covered"))


def ranking_quality(ranked: DataFrame, relevant: DataFrame, query_key: str = "query_id", key: str = "id", rank: str = "rank", at: int = 5, gain_at: int = 10) -> DataFrame:
    """(query_key, mrr, precision, ndcg) of every query with a relevant row: reciprocal rank of the first hit, share of hits in the first `at`, binary gain over the first `gain_at`."""
    truth = relevant.select(query_key, key).distinct()
    many = truth.groupBy(query_key).agg(F.count("*").alias("total"))
    hits = ranked.select(query_key, key, rank).join(truth, [query_key, key])
    found = hits.groupBy(query_key).agg(F.min(rank).alias("first"), F.count_if(F.col(rank) <= at).alias("in_at"), F.sum(F.when(F.col(rank) <= gain_at, 1 / F.log2(F.col(rank) + 1)).otherwise(0.0)).alias("gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("total"), F.lit(gain_at)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1.0))
    rows = many.join(found, query_key, "left")
    return rows.select(query_key, F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.coalesce(F.col("in_at") / at, F.lit(0.0)).alias("precision"), F.coalesce(F.col("gain") / ideal, F.lit(0.0)).alias("ndcg"))


def gate(rows: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """(metric, value, threshold, passed): a one-row table of metrics against their thresholds; a missing metric fails."""
    parts = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(t)).alias("threshold")) for m, t in thresholds.items()]
    flat = rows.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
    return flat.withColumn("passed", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False)))


def pack_by_budget(rows: DataFrame, budget: int, share: float = 0.75, tokens: str = "tokens", query_key: str = "query_id", key: str = "id", rank: str = "rank", separator: int = 16) -> DataFrame:
    """(query_key, rank, key, used, truncated): the leading rows of each list up to the first at which the running size, a separator each, reaches `share` of the budget.

    A row that would pass the budget ends the list with the mark [TRUNCATED]
    in its place, or stays, without its separator, where it is the first.
    """
    order = Window.partitionBy(query_key).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    own = F.col(tokens) + separator
    rows = rows.withColumn("_sum", F.sum(own).over(order)).withColumn("_before", F.col("_sum") - own)
    over = F.col("_sum") > budget
    rows = rows.where((F.col("_before") < int(budget * share)) & (F.col("_before") <= budget))
    first = F.col("_before") == 0
    return rows.select(query_key, rank, F.when(over & ~first, "[TRUNCATED]").otherwise(F.col(key)).alias(key), F.when(over, F.when(first, F.col(tokens)).otherwise(F.col("_before"))).otherwise(F.col("_sum")).cast("bigint").alias("used"), over.alias("truncated"))


_CJK = re.compile("[\u4e00-\u9fff\u3040-\u30ff\uac00-\ud7af]")
SEPARATOR = "\n\n---\n\n"


def _tokens(text: str) -> int:
    cjk = len(_CJK.findall(text))
    return math.ceil(cjk / 1.5 + (len(text) - cjk) / 3.5)


def _cut(text: str, budget: int) -> str:
    """The longest start within the budget, with an ellipsis where there is room for one."""
    if _tokens(text) <= budget:
        return text
    room = budget if budget < _tokens("...") else budget - _tokens("...")
    low, high = 0, len(text)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if _tokens(text[:middle]) <= room else (low, middle - 1)
    return text[:low] + ("" if budget < _tokens("...") else "...")


def pack_articles(rows: DataFrame, budget: int, context: int = 32_768, most: int = 10, query_key: str = "query_id", rank: str = "rank") -> DataFrame:
    """(query_key, place, article, title, url, ids, text, used): a context of the best articles within a token budget, at most 0.6 of `context`.

    Articles come in order of their best row, at most `most` of them; rows of
    an article in document order (section_idx, chunk_idx, missing ones last),
    under a header of title and url. Rows are added while they fit; the first
    that does not is cut to the room left and ends its article, and an article
    that finds no room ends the packing. The best article goes last, next to
    the question; `used` are the tokens of the whole context. `rows` needs id,
    article_key, title, doc_name, url, text, section_idx, chunk_idx; a group
    is one query's short list.
    """
    kinds = dict(rows.dtypes)
    limit = min(budget, int(context * 0.6))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(rank)
        blocks, used = [], 0
        for name in list(dict.fromkeys(pdf.article_key))[:most]:
            own = pdf[pdf.article_key == name].assign(s=lambda x: x.section_idx.fillna(10_000), c=lambda x: x.chunk_idx.fillna(10_000)).sort_values(["s", "c", rank], kind="stable")
            head = own.iloc[0]
            title = head.title or head.doc_name or "Untitled Article"
            url = head.url or name
            header, gap = f"### Article: {title}\nURL: {url}\n\n", _tokens(SEPARATOR) if blocks else 0
            room = limit - used - gap
            if used >= limit or room <= 0:
                break
            parts: list[str] = []
            ids = []
            for r in own.itertuples():
                text = r.text or ""
                if _tokens(header + "\n\n".join([*parts, text])) <= room:
                    parts.append(text)
                    ids.append(r.id)
                    continue
                short = _cut(text, max(0, room - _tokens(header + "\n\n".join(parts))))
                if short:
                    parts.append(short)
                    ids.append(r.id)
                break
            if not parts:
                continue
            body = "\n\n".join(parts)
            need = gap + _tokens(header + body)
            if used + need > limit:
                break
            blocks.append((name, title, url, ids, body, header + body))
            used += need
        if blocks and blocks[0][0] == pdf.article_key.iloc[0]:
            blocks.append(blocks.pop(0))
        total = _tokens(SEPARATOR.join(b[5] for b in blocks))
        out = [(pdf[query_key].iloc[0], i, *b[:5], total) for i, b in enumerate(blocks, 1)]
        return pd.DataFrame(out, columns=[query_key, "place", "article", "title", "url", "ids", "text", "used"])

    need = ("id", "article_key", "title", "doc_name", "url", "text", "section_idx", "chunk_idx", rank)
    return rows.select(query_key, *need).groupBy(query_key).applyInPandas(pack, f"`{query_key}` {kinds[query_key]}, place int, article string, title string, url string, ids array<{kinds['id']}>, text string, used bigint")


def prompt_context(blocks: DataFrame, query_key: str = "query_id") -> DataFrame:
    """(query_key, context): packed articles (place, title, url, text) as the numbered blocks of a prompt, texts escaped."""
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    body = F.concat_ws("\n", F.concat(F.lit("[ARTICLE id="), F.col("place"), F.lit("]")), part("title", F.col("title")), part("url", F.col("url")), F.lit("content:"), F.lit('"""'), escaped(F.col("text")), F.lit('"""'))
    return blocks.groupBy(query_key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", body.alias("body")))), lambda s: s["body"]), "\n\n").alias("context"))
