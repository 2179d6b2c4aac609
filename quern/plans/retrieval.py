"""Registered retrieval, ranking and evaluation queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import match_key
from quern.operators import dense as dn
from quern.operators import lexical as lx
from quern.operators import ranking as rk
from quern.operators import references as rf
from quern.operators.lexical import small
from quern.plans.session import cut_lineage

MODEL, DIM = "lark-embed-m", 64
# Words that are no keywords.
STOP = tuple(
    """the and for with that this from have has are was were how what can you your does did why who where when which will able into about using use set sets been more than such per any all each other should could would their them our ours its it's his her hers him she he they being also very much please need want like just make made give takes take some many few via etc etcetera""".split()
)
#: Weight of a hub page.
HUB = 0.6
#: A small synonym dictionary, term and synonyms in order.
SYNONYMS = (("invoices", ("bills", "billing documents")), ("export", ("download",)), ("lock", ("freeze", "close")), ("tags", ("labels",)), ("archive", ("store away", "retire")))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks, one row an id."""
    return table(spark, folder, "chunks").where("id is not null").groupBy("id").agg(F.max("text").alias("text"))


def chunk_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk ids and texts as they are stored, copies included: for operators that tell copies apart while they read."""
    return table(spark, folder, "chunks").where("id is not null").select("id", "text")


def chunk_rows(spark: SparkSession, folder: str, text: bool = False) -> DataFrame:
    """One row an id with its fields and keys, see `references.one_row`."""
    return rf.one_row(table(spark, folder, "chunks"), *(["text"] if text else []))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "eval_items").where("query is not null").groupBy("query").agg(*(F.min(c).alias(c) for c in ("relevant_chunk_ids", "tags", "notes")))
    return rows.select(F.col("query").alias("query_id"), "query", "relevant_chunk_ids", "tags", "notes")


def relevant(spark: SparkSession, folder: str) -> DataFrame:
    return questions(spark, folder).select("query_id", F.explode("relevant_chunk_ids").alias("id")).distinct()


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    latest = dn.latest_vectors(table(spark, folder, "embedding_responses"), MODEL, DIM).withColumnRenamed("chunk_id", "id")
    hubs = table(spark, folder, "chunks").where("id is not null").groupBy("id").agg(F.max(F.coalesce("metadata.is_hub", F.lit(False))).alias("hub"))
    return latest.join(hubs, "id")


def query_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """A question's vector is that of its first labelled chunk that has one: no embedding model is at hand."""
    labelled = questions(spark, folder).select("query_id", F.posexplode("relevant_chunk_ids").alias("pos", "id"))
    wanted = small(labelled.select("id").distinct())
    stored = table(spark, folder, "embedding_responses").join(wanted.withColumnRenamed("id", "chunk_id"), "chunk_id", "left_semi")
    latest = dn.latest_vectors(stored, MODEL, DIM).withColumnRenamed("chunk_id", "id").join(table(spark, folder, "chunks").select("id"), "id", "left_semi")
    return labelled.join(latest, "id").groupBy("query_id").agg(F.min_by("embedding", "pos").alias("embedding"))


def term_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return lx.term_counts(table(spark, folder, "documents"), "doc_id", "text")


def bm25_index_stats(spark: SparkSession, folder: str) -> DataFrame:
    return lx.term_statistics(corpus(spark, folder), "id", "text").select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = lx.bm25(questions(spark, folder), chunk_texts(spark, folder), keep=10).withColumn("bm25", F.round("bm25", 9))
    return lx.top(rows, 10, "bm25").select("query_id", "id", F.round("bm25", 6).alias("bm25"), "rank")


def lexical_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The twelve best chunks by title, section and text together, by BM25 in its Okapi form: what is measured where there are no vectors."""
    fields = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("title", "section", "text")))
    docs = chunk_rows(spark, folder, text=True).select("id", fields.alias("text"))
    rows = lx.okapi(questions(spark, folder), docs).withColumn("score", F.round("score", 9))
    return lx.top(rows, 12, "score").select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    best, _ = dn.dense_profile(query_vectors(spark, folder), vectors(spark, folder), keep=64)
    return lx.top(best.withColumn("dense", F.round("dense", 9)), 10, "dense").select("query_id", "id", F.round("dense", 6).alias("dense"), "rank")


def dense_moments(spark: SparkSession, folder: str) -> DataFrame:
    return dn.dense_moments(query_vectors(spark, folder), vectors(spark, folder)).select("query_id", F.round("mean", 6).alias("mean"), F.round("dev", 6).alias("dev"))


def _hybrid(spark: SparkSession, folder: str, k: int = 15, alpha: float = 0.5, hub: float = HUB) -> DataFrame:
    """The fused list of every question that has a vector, hub pages weighed by `hub` before the cut; written once."""
    stored = cut_lineage(vectors(spark, folder))
    asked = cut_lineage(query_vectors(spark, folder))
    lexical = lx.bm25(questions(spark, folder).join(asked.select("query_id"), "query_id", "left_semi"), chunk_texts(spark, folder), keep=3 * k).withColumn("bm25", F.round("bm25", 9))
    lexical = cut_lineage(lx.top(lexical, 3 * k, "bm25").select("query_id", "id", "bm25"))
    best, moments = dn.dense_profile(asked, stored, keep=4 * k, flag=F.col("hub"))
    order = Window.partitionBy("query_id", "flag").orderBy(F.desc("dense"), "id")
    best = best.withColumn("dense", F.round("dense", 9)).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= 4 * k).drop("_r")
    listed = dn.dense_of(lexical, asked, stored).join(stored.select("id", F.col("hub").alias("flag")), "id").select("query_id", "id", "flag", F.round("dense", 9).alias("dense"))
    candidates = best.select("query_id", "id", "flag", "dense").join(lexical.select("query_id", "id"), ["query_id", "id"], "left_anti").union(listed)
    return cut_lineage(rk.fuse(lexical, candidates, moments, k, alpha, hub))


def hybrid_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _hybrid(spark, folder, hub=1.0).select("query_id", "id", F.round("hybrid", 6).alias("hybrid"), "rank")


def hub_penalty(spark: SparkSession, folder: str) -> DataFrame:
    return _hybrid(spark, folder).select("query_id", "id", F.round("hybrid", 6).alias("hybrid"), "rank")


def _described(spark: SparkSession, folder: str, text: bool = False) -> DataFrame:
    """The fused list with the fields and keys of its chunks: only the chunks of the list are looked at."""
    ranked = _hybrid(spark, folder)
    own = table(spark, folder, "chunks").join(small(ranked.select("id").distinct(), 1_000_000), "id", "left_semi")
    return rf.one_row(own, *(["text"] if text else [])).join(small(ranked, 1_000_000), "id")


def dedup_topk(spark: SparkSession, folder: str) -> DataFrame:
    return rk.first_of(_described(spark, folder), ["article_key", "section"]).select("query_id", "id", "rank")


def diversity_limits(spark: SparkSession, folder: str) -> DataFrame:
    rows = rk.first_of(_described(spark, folder), ["article_key", "section"])
    return rk.diverse(rows, "article_key", "section_key", per_article=2, per_section=1).select("query_id", "id", "rank")


def mmr_select(spark: SparkSession, folder: str) -> DataFrame:
    short = small(_hybrid(spark, folder).select("query_id", "id", "dense"), 1_000_000).join(vectors(spark, folder), "id")
    return rk.marginal_relevance(short, 5)


def list_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and best score of every question's list, as a query log keeps them."""
    return _hybrid(spark, folder).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.avg("hybrid"), 6).alias("mean_score"), F.round(F.max("hybrid"), 6).alias("max_score"))


def confidence_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Confidence of every question from its dense scores; fused scores above 1 are clipped and would say the same of most questions."""
    return rk.confidence(dense_topk(spark, folder), score="dense")


def coverage_gate(spark: SparkSession, folder: str) -> DataFrame:
    return rk.covered(dense_topk(spark, folder))


def pack_dynamic(spark: SparkSession, folder: str) -> DataFrame:
    sized = _described(spark, folder, text=True).withColumn("tokens", F.greatest(F.lit(1), F.floor(F.length(F.coalesce("text", F.lit(""))) / 4)))
    return rk.pack_by_budget(sized, 1000)


def pack_articles(spark: SparkSession, folder: str) -> DataFrame:
    rows = rk.pack_articles(_described(spark, folder, text=True), 2000)
    return rows.select("query_id", "place", "article", "title", "url", F.array_join("ids", "|").alias("ids"), F.length("text").alias("n"), "used")


def prompt_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """The packed articles of every question as numbered prompt blocks."""
    rows = rk.prompt_context(rk.pack_articles(_described(spark, folder, text=True), 2000))
    return rows.select("query_id", F.length("context").alias("n"), F.size(F.regexp_extract_all("context", F.lit(r"(?m)^\[ARTICLE id=\d+\]$"), F.lit(0))).alias("blocks"))


def eval_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks that the questions' labels mean: by id, and by the title and section of each labelled chunk."""
    chunks = chunk_rows(spark, folder).select("id", "title", "section")
    named = relevant(spark, folder)
    by_name = named.join(chunks, "id").select("query_id", F.lit(None).cast("string").alias("chunk_id"), "title", "section")
    labels = named.select("query_id", F.col("id").alias("chunk_id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("section")).union(by_name)
    return rf.resolve_labels(labels, chunks)


def ir_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = rk.ranking_quality(bm25_topk(spark, folder), relevant(spark, folder))
    return rows.select("query_id", *(F.round(c, 6).alias(c) for c in ("mrr", "precision", "ndcg")))


def ir_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = rk.ranking_quality(bm25_topk(spark, folder), relevant(spark, folder))
    g = rows.agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{n}") for c in ("mrr", "precision", "ndcg") for n, f in (("mean", F.avg), ("dev", F.stddev_pop))))
    return g.select("n", *(F.round(c, 6).alias(c) for c in g.columns[1:]))


def eval_gate(spark: SparkSession, folder: str) -> DataFrame:
    """The mean ranking quality of the lexical list against what it must reach."""
    return rk.gate(ir_summary(spark, folder), {"mrr_mean": 0.65, "precision_mean": 0.35, "ndcg_mean": 0.60})


def keyword_overlap_topk(spark: SparkSession, folder: str) -> DataFrame:
    return lx.top(lx.keyword_overlap(questions(spark, folder), corpus(spark, folder)), 12, "overlap")


def question_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Keywords and phrases of every question, its tags and notes."""
    return lx.patterns_of(questions(spark, folder), STOP)


def heuristic_relevance(spark: SparkSession, folder: str) -> DataFrame:
    docs = chunk_rows(spark, folder, text=True).select("id", "title", "section", "url", "text")
    return lx.top(lx.heuristic_relevance(questions(spark, folder), docs, STOP), 3, "score")


def query_expand(spark: SparkSession, folder: str) -> DataFrame:
    rows = [(p, t, i, s) for p, (t, more) in enumerate(SYNONYMS) for i, s in enumerate(more)]
    synonyms = spark.createDataFrame(rows, "place int, term string, ord int, synonym string")
    asked = table(spark, folder, "query_responses").where("question is not null").select(F.col("response_id").alias("query_id"), F.col("question").alias("query"))
    return lx.expand(asked, synonyms).select("query_id", "expanded")


def cited_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """How often each known chunk is a source of an answer; unknown sources under their own id with known = false."""
    used = table(spark, folder, "query_responses").select(F.explode("sources").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    known = table(spark, folder, "chunks").select("id").distinct().withColumn("known", F.lit(True))
    return used.join(known, "id", "left").select("id", "n", F.coalesce("known", F.lit(False)).alias("known"))


def ivf_topk(spark: SparkSession, folder: str) -> DataFrame:
    index, centroids = dn.inverted_file(vectors(spark, folder).drop("hub"), 64)
    return dn.search_cells(index, centroids, query_vectors(spark, folder), 24, 10).select("query_id", "id", F.round("dense", 6).alias("dense"), "rank")


def title_map(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk ids of every title, a row each."""
    rows = table(spark, folder, "chunks").where("title is not null and id is not null")
    return rows.select(match_key(F.col("title")).alias("title"), "id").distinct()


def corpus_terms(spark: SparkSession, folder: str) -> DataFrame:
    return lx.held_terms(chunk_texts(spark, folder), "id", "text", []).select("id", "dl")


_T = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_BASE = f"""with c as (select id, max(text) as text from chunks where id is not null group by id),
q as (select distinct query as query_id, query from eval_items),
rel as (select distinct query as query_id, unnest(relevant_chunk_ids) as id from eval_items),
tok as (select id, {_T.format('text')} as ts from c where text is not null union all select id, [] from c where text is null),
dl as (select id, len(ts) as dl from tok),
tf as (select id, term, count(*) as tf from (select id, unnest(ts) as term from tok) group by all),
tdf as (select term, count(*) as df from tf group by term),
st as (select count(*) as n, sum(dl)/count(*) as avgdl from dl),
qt as (select query_id, term, count(*) as qtf from (select query_id, unnest({_T.format('query')}) as term from q) group by all),
bm as (select query_id, tf.id, round(sum(qtf*ln((n-df+0.5)/(df+0.5)+1)*tf*2.2/(tf+1.2*(1-0.65+0.65*dl/greatest(1.0,avgdl)))),9) as bm25
  from qt join tf using(term) join tdf using(term) join dl on dl.id = tf.id cross join st group by query_id, tf.id),
bmtop as (select * from (select query_id, id, bm25, row_number() over (partition by query_id order by bm25 desc, id) as rank from bm) where rank <= 10)"""
_VEC = f"""{_BASE},
ok as (select chunk_id as id, embedding::double[] as e, created_at, vec_id from embedding_responses where model = '{MODEL}' and chunk_id is not null and len(embedding) = {DIM}
  and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIM} and len(list_filter(embedding, lambda x: x <> 0)) > 0),
vec as (select id, e from (select *, row_number() over (partition by id order by created_at desc nulls last, vec_id desc) as r from ok) where r = 1 and id in (select id from c)),
ql as (select query as query_id, unnest(relevant_chunk_ids) as id, generate_subscripts(relevant_chunk_ids, 1) as pos from (select query, any_value(relevant_chunk_ids) as relevant_chunk_ids from eval_items group by query)),
qv as (select query_id, arg_min(e, pos) as q from ql join vec using(id) group by query_id),
den as (select query_id, id, round(list_cosine_similarity(e, q), 9) as dense from vec cross join qv),
dentop as (select * from (select *, row_number() over (partition by query_id order by dense desc, id) as rank from den) where rank <= 10)"""
_HYB = f"""{_VEC},
vn as (select count(*) as n from vec),
hubs as (select id, max(coalesce(metadata.is_hub, false)) as hub from chunks where id is not null group by id),
lex as (select * from (select query_id, id, bm25, row_number() over (partition by query_id order by bm25 desc, id) as r from bm where query_id in (select query_id from qv)) where r <= 45),
ls as (select query_id, sum(bm25)/n as lm, sqrt(greatest(0.0, sum(bm25*bm25)/n - (sum(bm25)/n)*(sum(bm25)/n))) as lsd from lex cross join vn group by query_id, n),
ds as (select query_id, avg(dense) as dm, stddev_pop(dense) as dsd from den group by query_id),
hf as (select den.query_id, den.id, hub, 0.5*coalesce(case when lsd > 0 then (coalesce(bm25,0)-lm)/lsd end, 0) + 0.5*coalesce(case when dsd > 0 then (dense-dm)/dsd end, 0) as f
  from den join hubs using(id) left join lex using(query_id, id) join ds using(query_id) left join ls using(query_id)),
plain as (select * from (select query_id, id, round(f, 9) as hybrid, row_number() over (partition by query_id order by round(f, 9) desc, id) as rank from hf) where rank <= 15),
hyr as (select * from (select query_id, id, h as hybrid, row_number() over (partition by query_id order by h desc, id) as rank from (select *, round(case when hub then f*0.6 else f end, 9) as h from hf)) where rank <= 15),
one as (select id, title, section, subsection, url, section_idx, chunk_idx, metadata, coalesce(nullif(url, ''), nullif(metadata.extra['url'], ''), nullif(metadata.extra['source_url'], ''), nullif(metadata.extra['doc_url'], ''), 'article:' || nullif(article_id, ''), 'article:' || nullif(metadata.extra['article_id'], ''), nullif(doc_name, ''), id) as article
  from (select *, row_number() over (partition by id order by coalesce(title, ''), coalesce(section, ''), coalesce(subsection, ''), coalesce(url, ''), coalesce(article_id, ''), coalesce(doc_name, ''), coalesce(section_idx, -1), coalesce(chunk_idx, -1), coalesce(metadata.section_type, ''), coalesce(metadata.breadcrumb, ''), coalesce(metadata.is_hub, false)) as pick from chunks where id is not null) where pick = 1),
hd as (select hyr.*, article, section, article || '::' || coalesce(nullif(section, ''), nullif(subsection, ''), nullif(metadata.section_type, ''), '') as skey, text from hyr join one using(id) join c using(id)),
dd as (select * from (select *, row_number() over (partition by query_id, article, section order by rank) as dn from hd) where dn = 1)"""
# words that are no keywords, one string
_STOP = "string_split('" + " ".join(STOP).replace("'", "''") + "', ' ')"
_FIELDS = f"""q as (select query as query_id, query, min(tags) as tags, min(notes) as notes from eval_items where query is not null group by query),
fld as (select query_id, unnest(list_filter([query] || coalesce(tags, []) || [notes], lambda x: x is not null)) as f from q),
ft as (select query_id, {_T.format('f')} as ts from fld),
kw as (select query_id, pattern, count(*) as times from (select query_id, unnest(ts) as pattern from ft) where length(pattern) > 2 and not list_contains({_STOP}, pattern) group by all),
bare as (select query_id, list_filter(ts, lambda w: not list_contains({_STOP}, w)) as ts from ft),
ph as (select distinct query_id, array_to_string(ts[i:i+k-1], ' ') as pattern, k as words from bare, range(2, 5) r(k), range(1, 200) s(i) where i + k - 1 <= len(ts) and length(array_to_string(ts[i:i+k-1], ' ')) > 3),
pat as (select query_id, pattern, cast(1 as int) as words, times from kw union all select query_id, pattern, cast(words as int), 1 from ph)"""


def _picks(k: int) -> str:
    """The k picks of marginal relevance, one after the other."""
    parts = ["m as (select hyr.query_id, hyr.id, dense, e from hyr join den using (query_id, id) join vec using (id))", "near as (select a.query_id, a.id, b.id as other, list_cosine_similarity(a.e, b.e) as s from m a join m b using (query_id))", "p1 as (select query_id, id, 1 as pick from (select *, row_number() over (partition by query_id order by round(dense, 12) desc, id) as r from m) where r = 1)"]
    for i in range(2, k + 1):
        parts.append(f"v{i} as (select m.query_id, m.id, round(0.75::double * any_value(dense) - 0.25::double * max(s), 12) as v from m join near using (query_id, id) join p{i - 1} p on p.query_id = near.query_id and p.id = near.other where (m.query_id, m.id) not in (select (query_id, id) from p{i - 1}) group by m.query_id, m.id)")
        parts.append(f"p{i} as (select * from p{i - 1} union all select query_id, id, {i} from (select *, row_number() over (partition by query_id order by v desc, id) as r from v{i}) where r = 1)")
    return ", ".join(parts)


SQL = {
    "term_frequencies": f"select doc_id, term, count(*) as tf from (select doc_id, unnest({_T.format('text')}) as term from documents) group by all",
    "bm25_index_stats": f"{_BASE} select term, df, round(ln((n-df+0.5)/(df+0.5)+1), 6) as idf from tdf cross join st",
    "bm25_topk": f"{_BASE} select query_id, id, round(bm25, 6) as bm25, rank from bmtop",
    "dense_topk": f"{_VEC} select query_id, id, round(dense, 6) as dense, rank from dentop",
    "dense_moments": f"{_VEC} select query_id, round(avg(dense), 6) as mean, round(stddev_pop(dense), 6) as dev from den group by query_id",
    "hybrid_topk": f"{_HYB} select query_id, id, round(hybrid, 6) as hybrid, rank from plain",
    "hub_penalty": f"{_HYB} select query_id, id, round(hybrid, 6) as hybrid, rank from hyr",
    "dedup_topk": f"{_HYB} select query_id, id, rank from dd",
    "diversity_limits": f"{_HYB} select query_id, id, rank from (select *, row_number() over (partition by query_id, article order by rank) as m from (select *, row_number() over (partition by query_id, skey order by rank) as n from dd) where n = 1) where m <= 2",
    "mmr_select": f"{_HYB}, {_picks(5)} select query_id, id, pick from p5",
    "list_scores": f"{_HYB} select query_id, count(*) as n, round(avg(hybrid), 6) as mean_score, round(max(hybrid), 6) as max_score from hyr group by query_id",
    "confidence_scores": f"""{_VEC}, s as (select query_id, greatest(0.0, least(1.0, round(dense, 6))) as s from dentop),
      g as (select query_id, max(s) as best, avg(s) as mean, count(*) as n, count(*) filter (where s >= 0.25) as good from s group by query_id),
      b as (select *, cast(trunc(case when best < 0.25 then best/0.25*40 else 40+(best-0.25)/0.75*60 end) as int) as base, case when best > 0 then mean/best else 0 end as ratio from g),
      d as (select *, case when n < 2 then base when ratio > 0.8 then least(100, base+5) when ratio < 0.5 then greatest(0, base-10) else base end as c from b)
      select query_id, greatest(0, least(100, case when good >= 3 then least(100, c+5) when good < 2 then greatest(0, c-10) else c end)) as confidence from d""",
    "coverage_gate": f"{_VEC} select query_id, count(*) as n, count(*) filter (where dense >= 0.25) as good, count(*) >= 2 and count(*) filter (where dense >= 0.25) >= 2 as covered from (select query_id, round(dense, 6) as dense from dentop) group by query_id",
    "pack_dynamic": f"""{_HYB}, z as (select query_id, rank, id, greatest(1, floor(length(coalesce(text, ''))/4)) as tokens from hd),
      w as (select *, sum(tokens + 16) over (partition by query_id order by rank rows between unbounded preceding and current row) as s from z), v as (select *, s - tokens - 16 as b from w)
      select query_id, rank, case when s > 1000 and b > 0 then '[TRUNCATED]' else id end as id, cast(case when s > 1000 then case when b = 0 then tokens else b end else s end as bigint) as used, s > 1000 as truncated from v where b < 750""",
    "ir_metrics": f"""{_BASE}, m as (select query_id, count(*) as total from rel group by query_id), h as (select bmtop.query_id, bmtop.rank from bmtop join rel using(query_id, id)),
      f as (select query_id, min(rank) as first, count(*) filter (where rank <= 5) as k, sum(case when rank <= 10 then 1/log2(rank+1) else 0 end) as gain from h group by query_id)
      select query_id, round(coalesce(1.0/first, 0), 6) as mrr, round(coalesce(k/5.0, 0), 6) as precision, round(coalesce(gain/list_sum(list_transform(range(1, least(total, 10)+1), lambda i: 1/log2(i+1))), 0), 6) as ndcg from m left join f using(query_id)""",
    "ir_summary": f"""{_BASE}, m as (select query_id, count(*) as total from rel group by query_id), h as (select bmtop.query_id, bmtop.rank from bmtop join rel using(query_id, id)),
      f as (select query_id, min(rank) as first, count(*) filter (where rank <= 5) as k, sum(case when rank <= 10 then 1/log2(rank+1) else 0 end) as gain from h group by query_id),
      r as (select query_id, coalesce(1.0/first, 0) as mrr, coalesce(k/5.0, 0) as precision, coalesce(gain/list_sum(list_transform(range(1, least(total, 10)+1), lambda i: 1/log2(i+1))), 0) as ndcg from m left join f using(query_id))
      select count(*) as n, round(avg(mrr), 6) as mrr_mean, round(stddev_pop(mrr), 6) as mrr_dev, round(avg(precision), 6) as precision_mean, round(stddev_pop(precision), 6) as precision_dev, round(avg(ndcg), 6) as ndcg_mean, round(stddev_pop(ndcg), 6) as ndcg_dev from r""",
    "keyword_overlap_topk": f"{_BASE} select query_id, id, overlap, rank from (select query_id, id, count(*) as overlap, row_number() over (partition by query_id order by count(*) desc, id) as rank from qt join tf using(term) group by query_id, id) where rank <= 12",
    "heuristic_relevance": f"""with {_FIELDS}, d as (select id, title, section, url from (select *, row_number() over (partition by id order by coalesce(title, ''), coalesce(section, ''), coalesce(subsection, ''), coalesce(url, ''), coalesce(article_id, ''), coalesce(doc_name, ''), coalesce(section_idx, -1), coalesce(chunk_idx, -1), coalesce(metadata.section_type, ''), coalesce(metadata.breadcrumb, ''), coalesce(metadata.is_hub, false)) as pick from chunks where id is not null) where pick = 1),
      t as (select d.*, x.text, {_T.format("concat_ws(' ', title, section, url)")} as lt, {_T.format("coalesce(x.text, '')")} as bt, lower(concat_ws(' ', nullif(title, ''), nullif(section, ''), nullif(url, ''), nullif(x.text, ''))) as blob from d join (select id, max(text) as text from chunks group by id) x using (id)),
      s as (select query_id, id, sum(case when words = 1 then times * (3.0*list_contains(lt, pattern)::int + 1.5*list_contains(bt, pattern)::int + 0.5) else 1.0 + 0.25*words end)::double as score from pat join t on contains(blob, pattern) group by query_id, id)
      select * from (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from s) where rank <= 3""",
    "query_expand": f"""with s(place, term, ord, synonym) as (values {", ".join(f"({p}, '{t}', {i}, '{x}')" for p, (t, more) in enumerate(SYNONYMS) for i, x in enumerate(more))}),
      q as (select response_id, regexp_replace(regexp_replace(question, '[\\s\\x{{0b}}\\x{{85}}\\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g') as question from query_responses where question is not null),
      w as (select distinct response_id, term from (select response_id, unnest({_T.format('question')}) as term from q)),
      m as (select response_id, string_agg(synonym, ' ' order by place, ord) as more from w join s using(term) group by response_id)
      select response_id as query_id, case when more is null then question else question || ' ' || more end as expanded from q left join m using(response_id)""",
    "cited_chunks": "select s.id, n, k.id is not null as known from (select id, count(*) as n from (select unnest(sources) as id from query_responses) group by id) s left join (select distinct id from chunks) k using(id)",
    "title_map": r"select distinct lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) as title, id from chunks where title is not null and id is not null",
    "lexical_topk": f"""{_BASE}, o as (select id, {_T.format("coalesce(title, '') || ' ' || coalesce(section, '') || ' ' || coalesce(c.text, '')")} as ts from (select id, title, section from (select *, row_number() over (partition by id order by coalesce(title, ''), coalesce(section, ''), coalesce(subsection, ''), coalesce(url, ''), coalesce(article_id, ''), coalesce(doc_name, ''), coalesce(section_idx, -1), coalesce(chunk_idx, -1), coalesce(metadata.section_type, ''), coalesce(metadata.breadcrumb, ''), coalesce(metadata.is_hub, false)) as pick from chunks where id is not null) where pick = 1) join c using (id)),
      ol as (select id, len(ts) as dl from o), oc as (select count(*) as n, avg(dl) as avgdl from ol), ot as (select id, term, count(*) as tf from (select id, unnest(ts) as term from o) group by all),
      od as (select term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) as idf from ot cross join oc group by term, n), oi as (select term, case when idf < 0 then 0.25 * (select avg(idf) from od) else idf end as idf from od),
      os as (select query_id, ot.id, round(sum(qtf*idf*tf*2.5/(tf+1.5*(0.25+0.75*dl/avgdl))), 9) as score from qt join ot using (term) join oi using (term) join ol on ol.id = ot.id cross join oc group by query_id, ot.id)
      select query_id, id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from os) where rank <= 12""",
    "eval_labels": r"""with o as (select id, title, section from (select *, row_number() over (partition by id order by coalesce(title, ''), coalesce(section, ''), coalesce(subsection, ''), coalesce(url, ''), coalesce(article_id, ''), coalesce(doc_name, ''), coalesce(section_idx, -1), coalesce(chunk_idx, -1), coalesce(metadata.section_type, ''), coalesce(metadata.breadcrumb, ''), coalesce(metadata.is_hub, false)) as pick from chunks where id is not null) where pick = 1),
      k as (select id, title is null as nameless, lower(trim(regexp_replace(coalesce(title, ''), '\s+', ' ', 'g'))) as t, lower(trim(regexp_replace(coalesce(section, ''), '\s+', ' ', 'g'))) as s from o),
      n as (select distinct query as query_id, unnest(ids) as id from (select query, min(relevant_chunk_ids) as ids from eval_items where query is not null group by query)), a as (select distinct query_id, t, s from n join k using (id) where not nameless)
      select query_id, id from n where id in (select id from k) union select query_id, k.id from a join k on a.t = k.t and a.s = k.s where a.s <> '' union select query_id, k.id from a join k on a.t = k.t where a.s = ''""",
    "eval_gate": f"""{_BASE}, m as (select query_id, count(*) as total from rel group by query_id), h as (select bmtop.query_id, bmtop.rank from bmtop join rel using(query_id, id)),
      f as (select query_id, min(rank) as first, count(*) filter (where rank <= 5) as k, sum(case when rank <= 10 then 1/log2(rank+1) else 0 end) as gain from h group by query_id),
      r as (select coalesce(1.0/first, 0) as mrr, coalesce(k/5.0, 0) as precision, coalesce(gain/list_sum(list_transform(range(1, least(total, 10)+1), lambda i: 1/log2(i+1))), 0) as ndcg from m left join f using(query_id)),
      v as (select 'mrr_mean' as metric, round(avg(mrr), 6) as value, 0.65::double as threshold from r union all select 'precision_mean', round(avg(precision), 6), 0.35 from r union all select 'ndcg_mean', round(avg(ndcg), 6), 0.60 from r)
      select metric, value, threshold, coalesce(value >= threshold, false) as passed from v""",
    "question_patterns": f"with {_FIELDS} select query_id, pattern, words, times from pat",
    "corpus_terms": f"{_BASE} select id, dl from dl",
}
QUERIES = (term_frequencies, bm25_index_stats, bm25_topk, lexical_topk, dense_topk, dense_moments, hybrid_topk, hub_penalty, dedup_topk, diversity_limits, mmr_select, list_scores, confidence_scores, coverage_gate, pack_dynamic, pack_articles, prompt_contexts, eval_labels, ir_metrics, ir_summary, eval_gate, keyword_overlap_topk, question_patterns, heuristic_relevance, query_expand, cited_chunks, ivf_topk, title_map, corpus_terms)
