"""Operators against small models and by hand."""

import math
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import chunking, dense, lexical, metrics, ranking, references, state
from quern.operators.components import connected_components


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(0, "red fox red"), (1, "blue sky"), (2, "red sky over sea"), (3, None)], "id int, text string")
    queries = spark.createDataFrame([(1, "red red sky"), (2, "none")], "query_id int, query string")
    got = {(r.query_id, r.id): r.bm25 for r in lexical.bm25(queries, docs).collect()}
    n, avg = 4, (3 + 2 + 4 + 0) / 4
    size = {0: 3, 1: 2, 2: 4}
    tf = {(0, "red"): 2, (1, "sky"): 1, (2, "red"): 1, (2, "sky"): 1}
    expected = defaultdict(float)
    for t in ("red", "red", "sky"):
        df = sum(w == t for _, w in tf)
        for (d, w), f in tf.items():
            if w == t:
                expected[1, d] += math.log((n - df + 0.5) / (df + 0.5) + 1) * f * 2.2 / (f + 1.2 * (1 - 0.65 + 0.65 * size[d] / avg))
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_top_breaks_ties_by_key(spark):
    rows = spark.createDataFrame([(1, "b", 1.0), (1, "a", 1.0), (1, "c", 2.0)], "query_id int, id string, s double")
    assert [r.id for r in lexical.top(rows, 2, "s").orderBy("rank").collect()] == ["c", "a"]


def test_expand(spark):
    q = spark.createDataFrame([(1, "lock tags"), (2, "nothing")], "query_id int, query string")
    s = spark.createDataFrame([(0, "tags", 0, "labels"), (1, "lock", 0, "freeze"), (1, "lock", 1, "labels")], "place int, term string, ord int, synonym string")
    got = {r.query_id: r.expanded for r in lexical.expand(q, s).collect()}
    assert got == {1: "lock tags labels freeze", 2: "nothing"}
    assert lexical.expand(q, s, most=18).where("query_id = 1").first().expanded == "lock tags labels"
    assert lexical.expand(q, s, most=9).where("query_id = 1").first().expanded == "lock tags"


@pytest.fixture(scope="module")
def space():
    x = np.random.default_rng(42).normal(size=(1500, 24))
    x[3], x[4, 0], x[5, 0] = 0, np.nan, np.inf
    return x


def test_dense_against_numpy(spark, space):
    rows = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(space)], "id int, embedding array<float>")
    good = rows.where(dense.usable(F.col("embedding"), 24))
    assert good.count() == len(space) - 3
    queries = rows.where("id in (0, 10)").withColumnRenamed("id", "query_id")
    x = np.delete(space, [3, 4, 5], axis=0).astype("f4").astype(float)
    ids = np.delete(np.arange(len(space)), [3, 4, 5])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for keep in (None, 7):
        got = lexical.top(dense.dense_scores(queries, good, keep=keep), 5, "dense")
        for q in (0, 10):
            best = ids[np.argsort(-(x @ x[list(ids).index(q)]))[:5]]
            assert [r.id for r in got.where(f"query_id = {q}").orderBy("rank").collect()] == list(best)


def test_inverted_file_recall(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(40, 16))
    x = centers[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, embedding array<float>")
    index, centroids = dense.inverted_file(rows, 40)
    assert index.count() == 3000
    queries = rows.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    found = dense.search_cells(index, centroids, queries, 8, 10).collect()
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = sum(r.id in set(np.argsort(-(n @ n[r.query_id]))[:10]) for r in found)
    assert hits >= 0.9 * 300


def test_fusion_counts_missing_as_zero_and_weighs_hubs(spark):
    bm = spark.createDataFrame([(1, "a", 4.0), (1, "b", 2.0)], "query_id int, id string, bm25 double")
    d = np.array([0.1, 0.9, 0.5, 0.3])
    found = spark.createDataFrame([(1, k, k == "b", v) for k, v in zip("abcd", d.tolist())], "query_id int, id string, flag boolean, dense double")
    moments = spark.createDataFrame([(1, 4, float(d.mean()), float(d.std()))], "query_id int, n bigint, mean double, dev double")
    rows = {r.id: r.hybrid for r in ranking.fuse(bm, found, moments, k=4, factor=0.6).collect()}
    b = np.array([4.0, 2, 0, 0])
    expected = (0.5 * (b - b.mean()) / b.std() + 0.5 * (d - d.mean()) / d.std()) * np.array([1, 0.6, 1, 1])
    assert all(abs(rows[k] - e) < 1e-8 for k, e in zip("abcd", expected))


def test_profile_of_both_flags(spark, space):
    rows = spark.createDataFrame([(i, [float(v) for v in x], i % 50 == 0) for i, x in enumerate(space) if i not in (3, 4, 5)], "id int, embedding array<float>, hub boolean")
    queries = rows.where("id in (0, 10)").withColumnRenamed("id", "query_id")
    best, moments = dense.dense_profile(queries, rows, 4, F.col("hub"))
    x = np.delete(space, [3, 4, 5], axis=0).astype("f4").astype(float)
    ids = np.delete(np.arange(len(space)), [3, 4, 5])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 10):
        cos = x @ x[list(ids).index(q)]
        m = moments.where(f"query_id = {q}").first()
        assert m.n == len(ids) and abs(m["mean"] - cos.mean()) < 1e-9 and abs(m.dev - cos.std()) < 1e-9
        for flag in (False, True):
            own = [(-c, i) for c, i in zip(cos, ids) if (i % 50 == 0) == flag]
            got = {r.id for r in best.where(f"query_id = {q} and flag = {flag}").collect()}
            assert {int(i) for _, i in sorted(own)[:4]} <= got


def test_bm25_ways_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, " ".join(f"t{w}" for w in rng.integers(0, 30, rng.integers(0, 20)))) for i in range(300)] + [(7, None)], "id int, text string")
    queries = spark.createDataFrame([(i, " ".join(f"t{w}" for w in rng.integers(0, 30, 4))) for i in range(5)], "query_id int, query string")
    one = {(r.query_id, r.id): r.bm25 for r in lexical.bm25(queries, docs).collect()}
    best = lexical.top(lexical.bm25(queries, docs, keep=3), 3, "bm25").collect()
    monkeypatch.setattr(lexical, "PAIRS", 2)
    two = {(r.query_id, r.id): r.bm25 for r in lexical.bm25(queries, docs).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)
    for q in range(5):
        own = sorted((v for (a, _), v in one.items() if a == q), reverse=True)[:3]
        assert np.allclose(sorted((r.bm25 for r in best if r.query_id == q), reverse=True), own)


def test_equal_scores_have_z_zero(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 2.0)], "query_id int, s double")
    r = rows.groupBy("query_id").agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("dev")).select(ranking.z(F.lit(2.0), F.col("mean"), F.col("dev")).alias("z")).first()
    assert r.z == 0


def test_diversity_and_dedup(spark):
    rows = spark.createDataFrame([(1, i, a, s, i) for i, (a, s) in enumerate([("x", "1"), ("x", "1"), ("x", "2"), ("x", "3"), ("y", "1")], 1)], "query_id int, id int, article string, section string, rank int")
    assert sorted(r.id for r in ranking.diverse(rows).collect()) == [1, 3, 5]
    assert sorted(r.id for r in ranking.first_of(rows, ["article", "section"]).collect()) == [1, 3, 4, 5]
    assert ranking.diverse(rows, per_article=0, per_section=0).count() == 5


def test_marginal_relevance(spark):
    rows = spark.createDataFrame([(1, "a", 0.9, [1.0, 0.0]), (1, "b", 0.89, [1.0, 0.0]), (1, "c", 0.6, [0.0, 1.0])], "query_id int, id string, dense double, embedding array<double>")
    got = [r.id for r in ranking.marginal_relevance(rows, 3).orderBy("pick").collect()]
    assert got == ["a", "c", "b"]


def test_ranking_quality(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "z", 1)], "query_id int, id string, rank int")
    truth = spark.createDataFrame([(1, "b"), (1, "c"), (1, "b"), (2, "q"), (3, "q")], "query_id int, id string")
    got = {r.query_id: r for r in ranking.ranking_quality(ranked, truth).collect()}
    assert got[1].mrr == 0.5 and got[1].precision == 0.4
    assert abs(got[1].ndcg - (1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3))) < 1e-12
    assert got[2].mrr == got[3].ndcg == 0


PACK = "query_id int, id string, article_key string, title string, doc_name string, url string, text string, section_idx int, chunk_idx int, rank int"


def test_articles_are_packed_in_document_order_best_last(spark):
    rows = [(1, "x1", "A", "Art A", None, "u/a", "second part", 2, 0, 1), (1, "y1", "B", None, "Doc B", None, "other", None, None, 2), (1, "x0", "A", "Art A", None, "u/a", "first part", 1, 0, 3)]
    got = ranking.pack_articles(spark.createDataFrame(rows, PACK), 1000).orderBy("place").collect()
    assert [(r.article, r.title, r.url, r.ids, r.text) for r in got] == [("B", "Doc B", "B", ["y1"], "other"), ("A", "Art A", "u/a", ["x0", "x1"], "first part\n\nsecond part")]
    whole = "### Article: Doc B\nURL: B\n\nother" + ranking.SEPARATOR + "### Article: Art A\nURL: u/a\n\nfirst part\n\nsecond part"
    assert {r.used for r in got} == {math.ceil(len(whole) / 3.5)}
    context = ranking.prompt_context(ranking.pack_articles(spark.createDataFrame(rows, PACK), 1000)).first().context
    assert context.startswith("[ARTICLE id=1]\ntitle: Doc B\nurl: B\ncontent:\n\"\"\"\nother") and "[ARTICLE id=2]" in context


def test_an_article_beyond_the_budget_is_cut(spark):
    rows = [(1, "a", "A", "A", None, "u", "alpha " * 200, 1, 1, 1), (1, "b", "B", "B", None, "v", "beta " * 200, 1, 1, 2)]
    got = ranking.pack_articles(spark.createDataFrame(rows, PACK), 12_000, context=50).collect()
    assert [(r.ids, r.text.endswith("..."), r.used <= 30) for r in got] == [(["a"], True, True)]
    assert ranking.pack_articles(spark.createDataFrame(rows, PACK), 0).count() == 0


def test_dynamic_packing(spark):
    rows = [(1, f"c{i}", i, 40) for i in range(1, 6)] + [(2, "big", 1, 500), (2, "more", 2, 5)]
    df = spark.createDataFrame(rows, "query_id int, id string, rank int, tokens int")
    got = [(r.query_id, r.id, r.used, r.truncated) for r in ranking.pack_by_budget(df, 200).orderBy("query_id", "rank").collect()]
    assert got == [(1, "c1", 56, False), (1, "c2", 112, False), (1, "c3", 168, False), (2, "big", 500, True)]
    got = [(r.query_id, r.id, r.used) for r in ranking.pack_by_budget(df, 160, share=1.0).orderBy("query_id", "rank").collect()]
    assert got == [(1, "c1", 56), (1, "c2", 112), (1, "[TRUNCATED]", 112), (2, "big", 500)]


def test_confidence_steps(spark):
    lists = {1: [0.9, 0.85, 0.8], 2: [0.9, 0.1], 3: [0.1], 4: [0.0, 0.0], 5: [5.0, 4.0, 3.0]}
    df = spark.createDataFrame([(q, s) for q, ss in lists.items() for s in ss], "query_id int, hybrid double")
    got = {r.query_id: r.confidence for r in ranking.confidence(df).collect()}
    assert got == {1: 100, 2: 82, 3: 6, 4: 0, 5: 100}


def test_labels(spark):
    chunks = spark.createDataFrame([("a", "Set  up", "One"), ("b", "set up", "two"), ("c", "Other", None)], "id string, title string, section string")
    labels = spark.createDataFrame([(1, "a", None, None), (1, "gone", None, None), (2, None, "SET UP", "Two"), (3, None, "set up", "none such"), (4, None, "other", None), (5, None, "nowhere", "x")], "query_id int, chunk_id string, title string, section string")
    got = sorted((r.query_id, r.id) for r in references.resolve_labels(labels, chunks).collect())
    assert got == [(1, "a"), (2, "b"), (3, "a"), (3, "b"), (4, "c")]


def test_sources_are_matched(spark):
    context = spark.createDataFrame([(1, 0, "https://h.example/a/b/"), (1, 1, "https://h.example/a"), (1, 2, "https://H.example/a/b#x"), (2, 0, None)], "r int, place int, url string")
    named = spark.createDataFrame([(1, "HTTPS://h.example/a/b#top"), (1, "https://h.example/a/"), (1, "h.example/a/b/c/"), (1, "https://other.example"), (2, "x")], "r int, source string")
    got = {r.source: r.url for r in references.match_sources(named, context, "r").collect()}
    assert got == {"HTTPS://h.example/a/b#top": "https://h.example/a/b/", "https://h.example/a/": "https://h.example/a"}


def test_values_at_ranks(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(size=501).tolist(), "b": [3.0] * 20, "c": [1.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("a", None)], "k string, v double")
    got = {r.k: r for r in metrics.bench_summary(df, "k", "v").collect()}
    for k, vs in values.items():
        vs = sorted(vs)
        assert got[k].n == len(vs) and got[k].p95 == vs[min(int(0.95 * len(vs)), len(vs) - 1)] and abs(got[k].median - np.median(vs)) < 1e-12


def test_windows(spark):
    rows = spark.createDataFrame([(1, "x" * 500), (2, "short"), (3, ""), (4, None)], "k int, t string")
    got = [(r.k, r.window, r.start, len(r.piece)) for r in chunking.character_windows(rows, "k", "t", 200, 50).orderBy("k", "window").collect()]
    assert got == [(1, 0, 0, 200), (1, 1, 150, 200), (1, 2, 300, 200), (2, 0, 0, 5)]
    with pytest.raises(ValueError):
        chunking.character_windows(rows, "k", "t", 10, 10)


DOC = """---
id: k1
title: "First page"
tags: [a, b]
url: https://x.example/1
---
intro
## Setup
step one
### Detail
more

## Use
text
---
title: Hidden
suppress_from_rag: true
---
secret
"""


def test_build_chunks(spark):
    docs = spark.createDataFrame([("d/first.md", DOC), ("d/second.md", "# [ARTICLE] Second\nhttps://x.example/2\nbody line\n# [ARTICLE] Third\nonly body"), ("d/plain.md", "just text"), ("d/none.md", None)], "path string, text string")
    rows = chunking.build_chunks(docs).collect()
    titles = {r.title for r in rows}
    assert titles == {"First page", "Second", "Third", "KB"} and not any("secret" in r.text for r in rows)
    first = sorted((r for r in rows if r.title == "First page"), key=lambda r: r.section_idx)
    assert [r.section for r in first] == ["intro", "Setup", "Use"]
    assert first[1].subsection == "Detail" and first[1].text.startswith("Context: First page > Setup > Detail\n\n") and first[1].url == "https://x.example/1"
    assert {r.url for r in rows if r.title == "Second"} == {"https://x.example/2"}
    assert {r.article_id for r in rows if r.title == "First page"} == {"k1"} and all(r.id.startswith(f"k1_{r.section_idx}_{r.chunk_idx}_") and len(r.id) == 15 for r in first)
    assert first[0].metadata.breadcrumb == "First page > intro" and first[0].metadata.section_type == "intro" and first[0].metadata.section_importance is None
    marked = chunking.build_chunks(spark.createDataFrame([("a.md", "# [ARTICLE] Guide - Help\n## Key points\nx\n## Short FAQ\ny\n## guide\nz")], "path string, text string"), title_suffix=" - Help").orderBy("section_idx").collect()
    assert [r.metadata.section_importance for r in marked] == ["high", "medium", None] and [r.metadata.breadcrumb for r in marked] == ["Guide > Key points", "Guide > Short FAQ", "Guide"]


def test_boundary_pieces(spark):
    paragraphs = "\n\n".join(f"Paragraph {i}. " + "word " * 30 for i in range(20))
    sentences = " ".join(f"Sentence {i} has some words." for i in range(60))
    texts = {1: paragraphs, 2: "y" * 1000, 3: "  ", 4: None, 5: "intro\n- one " + "a" * 300 + "\n- two\n2. three\n\n\n## Four\n" + "b" * 90, 6: sentences, 7: "short \t text", 8: "One. " + "z" * 700 + ". Two. Three."}
    df = spark.createDataFrame(list(texts.items()), "id int, t string")
    got = {r.id: r.p for r in df.select("id", chunking.boundary_pieces(F.col("t"), 400, 50).alias("p")).collect()}
    assert all(0 < len(p) <= 400 for pieces in got.values() for p in pieces)
    assert all(f"Paragraph {i}." in "\n".join(got[1]) for i in range(20)) and got[1][0].count("Paragraph") == 2
    assert got[2] == ["y" * 400, "y" * 400, "y" * 300] and got[3] == [] and got[4] == [] and got[7] == ["short \t text"]
    assert got[5] == ["intro\n- one " + "a" * 300 + "\n- two\n2. three", "## Four\n" + "b" * 90]
    assert all(p.startswith("Sentence") and p.endswith("words.") for p in got[6]) and all(a.split(". ")[-1] == b.split(". ")[0] + "." for a, b in zip(got[6], got[6][1:]))
    assert got[8][0] == "One." and got[8][1] == "z" * 400 and got[8][-1] == "Two. Three."
    plain = {r.id: r.p for r in df.select("id", chunking.boundary_pieces(F.col("t"), 400, 50, sentences=False).alias("p")).collect()}
    assert plain[6][0] == sentences[:400].strip() and plain[6][1] == sentences[350:750].strip()


def test_histogram_ranks_and_counters(spark):
    rows = [(f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", "histogram", "lat", {"e": "q"}, float(i + 1)) for i in range(100)]
    rows += [("2024-01-01 00:00:00", "counter", "hits", None, 2.0), ("2024-01-01 00:00:01", "counter", "hits", {}, 3.0), ("2024-01-01 00:00:01", "counter", "hits", {}, 3.0), ("2024-01-01 00:00:02", "counter", "hits", {}, -4.0), ("2024-01-01 00:00:03", "counter", "hits", {}, float("nan")), ("2024-01-01 00:00:04", "gauge", "g", {"b": "2", "a": "1"}, 7.0)]
    df = spark.createDataFrame(rows, "ts string, kind string, name string, labels map<string,string>, value double").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("received_at", F.col("ts")).withColumn("collector", F.lit("c"))
    s = metrics.samples(df)
    h = metrics.histograms(s).first()
    assert (h["count"], h.min, h.max, h.p50, h.p95, h.p99) == (100, 1, 100, 51, 95, 99)
    assert metrics.histograms(s, history=10).first().min == 91
    assert metrics.counters(s).first().total == 5
    assert metrics.gauges(s).first().labels == "{a=1,b=2}"
    assert metrics.summary(s).count() == 2


def model_limit(times, most, span):
    accepted, out = deque(), []
    for t in times:
        while accepted and accepted[0] < t - span:
            accepted.popleft()
        ok = len(accepted) < most
        if ok:
            accepted.append(t)
        out.append(ok)
    return out


def test_limiter_counts_accepted_only(spark):
    rng = np.random.default_rng(3)
    rows = [(k, int(i), float(t)) for k in "ab" for i, t in enumerate(np.sort(rng.uniform(0, 100, 80)))]
    df = spark.createDataFrame(rows, "key string, n int, s double").withColumn("at", F.timestamp_micros((F.col("s") * 1_000_000).cast("bigint"))).withColumn("us", (F.col("s") * 1_000_000).cast("bigint"))
    got = state.rate_limit(df, "key", "at", ["n"], ["key", "n", "us"], most=3, seconds=10).collect()
    for k in "ab":
        own = sorted((r.us, r.n, r.allowed) for r in got if r.key == k)
        assert [o[2] for o in own] == model_limit([o[0] for o in own], 3, 10_000_000)


def test_cache_and_breaker():
    cache = state.Cache(2, 10)
    assert [cache.ask(k, t) for k, t in (("a", 0), ("a", 5), ("b", 6), ("c", 7), ("a", 8), ("c", 30))] == ["miss", "hit", "miss", "miss_evict", "miss_evict", "expired"]
    breaker = state.Breaker(2, 10)
    assert [breaker.report(t, ok) for t, ok in ((0, False), (1, False), (2, True), (12, False), (13, True), (25, True), (26, False))] == ["closed", "open", "open", "open", "open", "closed", "closed"]


def test_profile_summary(spark):
    schema = "dense_dot_time_ms double, dense_computed int, dense_saved int, dense_total int, candidates int, used_faiss boolean, used_hnsw boolean"
    rows = [(1.0, 10, 5, 15, 4, False, True), (2.0, None, 1, 15, 5, None, False)]
    assert tuple(metrics.profile_summary(spark.createDataFrame(rows, schema)).first()) == ("hnsw", 1.5, 5.0, 3.0, 0.2, 4.5)
    assert tuple(metrics.profile_summary(spark.createDataFrame([(None,) * 7], schema)).first()) == ("linear", 0.0, 0.0, 0.0, 0.0, 0.0)
    assert metrics.profile_summary(spark.createDataFrame([], schema)).count() == 0


def test_export_and_query_records(spark):
    schema = "response_id int, question string, answer string, refused boolean, confidence double, timing struct<total_ms:double,retrieve_ms:double,llm_ms:double>, routing struct<action:string,level:string,escalated:boolean>"
    got = metrics.query_records(spark.createDataFrame([(1, "q" * 150, "a", True, 7.0, (3.0, None, 1.0), ("auto", None, True)), (2, None, None, None, None, None, None)], schema)).orderBy("response_id").collect()
    assert tuple(got[0]) == (1, 150, "q" * 100, 1, True, 7.0, 3.0, 0.0, 1.0, "auto", "unknown", True)
    assert tuple(got[1]) == (2, 0, None, 0, False, None, 0.0, 0.0, 0.0, "unknown", "unknown", False)
