import io
import json
import zipfile

import pytest

from pyspark.sql import functions as F

from quern.operators import embeddings
from quern.plans import providers
from quern.sources import readers, tables


def test_documents_of_all_kinds(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# Title\ntext")
    (tmp_path / "sub" / "b.html").write_text("<p>one</p><style>x</style><p>two</p>")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>para</w:t></w:p><w:p><w:t>two</w:t></w:p></w:document>')
    (tmp_path / "c.docx").write_bytes(data.getvalue())
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "other.bin").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error is not None) for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("# Title\ntext", False), "b.html": ("one two", False), "c.docx": ("para\ntwo", False), "broken.docx": (None, True), "other.bin": ("x", False)}
    assert readers.read_markdown(spark, str(tmp_path)).count() == 1


def test_article_and_issues(spark):
    row = spark.createDataFrame([("a\n\n b ",)], "t string").select(readers.as_article(F.lit("T"), F.lit("file://x"), F.col("t")).alias("a"), readers.article_issues(F.col("t")).alias("i")).first()
    assert row.a == "# [ARTICLE] T\nfile://x\n\na\nb" and row.i == ["no article heading", "too short"]


def test_caches_and_lists(spark, tmp_path):
    e = tmp_path / "e.jsonl"
    e.write_text("\n".join(json.dumps(x) for x in ({"hash": "h", "embedding": [1, 2], "backend": "l"}, {"hash": "h", "embedding": [3, 4], "backend": "l"}, {"hash": "k", "embedding": [1], "backend": "l"})) + "\nbroken\n")
    got = readers.read_embedding_cache(spark, str(e), 2).collect()
    assert len(got) == 1 and got[0].embedding == [3, 4]
    (tmp_path / "s.json").write_text('{"Lock ": [" freeze", ""], "": ["x"]}')
    assert [tuple(r) for r in readers.read_synonyms(spark, str(tmp_path / "s.json")).collect()] == [("lock", 0, "freeze")]
    (tmp_path / "q.txt").write_text("# head\n\n How? \n")
    assert [r.question for r in readers.read_questions(spark, str(tmp_path / "q.txt")).collect()] == ["How?"]


def test_embedding_cache_by_content(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "red fox"), ("b", "red sky"), ("b", "red sky"), ("n", None)], "id string, text string")
    h = {r.id: r.hash for r in embeddings.lookup(chunks, spark.createDataFrame([], "hash string, vec_id bigint, embedding array<float>")).collect()}
    rows = [(1, h["a"], "m", [1.0, 0.0], "2024-01-01"), (2, h["a"], "m", [0.0, 1.0], "2024-01-02"), (3, "gone", "m", [1.0, 1.0], "2024-01-01"), (4, h["b"], "m", [0.0, 0.0], "2024-01-01"), (5, None, "m", [1.0, 1.0], "2024-01-01")]
    responses = spark.createDataFrame(rows, "vec_id bigint, hash string, model string, embedding array<float>, created_at string")
    cached = embeddings.cache(responses, "m", 2)
    assert {r.id: r.vec_id for r in embeddings.lookup(chunks, cached).collect()} == {"a": 2, "b": None}
    assert [r.hash for r in embeddings.misses(chunks, cached).collect()] == [h["b"]] and [r.vec_id for r in embeddings.stale(chunks, cached).collect()] == [3]
    tables.write_embedding_cache(cached.withColumn("backend", F.lit("l")).withColumn("model", F.lit("m")), str(tmp_path / "cache"))
    assert {r.hash: r.embedding for r in readers.read_embedding_cache(spark, str(tmp_path / "cache"), 2, "l").collect()} == {h["a"]: [0.0, 1.0], "gone": [1.0, 1.0]}


def test_index_versions(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "red fox"), ("b", "red sky")], "id string, text string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0])], "id string, embedding array<double>")
    index = tables.Index(str(tmp_path / "index"))
    sign = tables.signature(chunks, "id", "text").first().signature
    assert not tables.fresh(index, spark, sign, "m")
    tables.build(index, chunks, vectors, "2024-01-01T00:00:00Z", "v1", sign, "m")
    assert tables.fresh(index, spark, sign, "m") and not tables.fresh(index, spark, sign, "other")
    tables.build(index, chunks.limit(1), vectors, "2024-01-02T00:00:00Z", "v2", "other corpus", "m")
    assert index.version(spark) == "v2" and not tables.fresh(index, spark, sign, "m")
    tables.build(index, chunks, vectors, "2024-01-03T00:00:00Z", "v3", sign, "m")
    assert index.read(spark, "chunks", model="m", dim=2).count() == 2
    with pytest.raises(ValueError):
        index.read(spark, "vectors", dim=3)
    assert {r.term: r.df for r in index.read(spark, "terms").collect()} == {"red": 2, "fox": 1, "sky": 1}
    assert sign == tables.signature(chunks.orderBy(F.desc("id")), "id", "text").first().signature


def test_log_has_no_texts(spark, tmp_path):
    rows = spark.sql("select 'q' as query, array(named_struct('id', 'a', 'text', 'secret')) as retrieved_chunks")
    tables.append_log(rows, str(tmp_path / "log"))
    assert "secret" not in "".join(p.read_text() for p in (tmp_path / "log").glob("*.json"))


def test_providers(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "id int, t string")
    got = {r.id: r.embedding for r in providers.provider("embedder", "hashed")(rows, "id", "t", 8).collect()}
    assert got[1] == got[2] and 3 not in got and abs(sum(v * v for v in got[1]) - 1) < 1e-5
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "z", 1)], "query_id int, id string, rank int")
    answers = spark.createDataFrame([(1, '[{"id":"c","score":2},{"id":"a","score":1},{"id":"q","score":9}]'), (2, "oops")], "query_id int, answer string")
    out = [(r.query_id, r.id, r["rank"]) for r in providers.rerank_by_answers(ranked, answers).orderBy("query_id", "rank").collect()]
    assert out == [(1, "c", 1), (1, "a", 2), (2, "z", 1)]


def test_answer_cache(spark, tmp_path):
    at = str(tmp_path / "answers")
    assert readers.read_answer_cache(spark, at, "s1").count() == 0
    rows = spark.createDataFrame([("k1", "b"), ("k1", "a"), ("k2", None), (None, "x")], "key string, answer string")
    tables.write_answer_cache(rows, at, "s1")
    got = {r.key: r.answer for r in readers.read_answer_cache(spark, at, "s1").collect()}
    assert got == {"k1": "a", "k2": None} == {r.key: r.answer for r in readers.read_answer_cache(spark, at).collect()}
    assert readers.read_answer_cache(spark, at, "s2").count() == 0
    tables.write_answer_cache(rows, at, None)
    assert readers.read_answer_cache(spark, at, "s2").count() == 0 and readers.read_answer_cache(spark, at).count() == 2
    meta = spark.createDataFrame([({"kb_sha": "b", "kb_sha256": ""},), ({"kb_signature": "c"},), ({},), (None,)], "m map<string,string>")
    assert [r[0] for r in meta.select(readers.corpus_signature(meta.m)).collect()] == ["b", "c", None, None]


def test_unknown_extensions_are_text(spark, tmp_path):
    (tmp_path / "a.log").write_text("plain")
    (tmp_path / "b.md").write_text("# b")
    assert {(r.kind, r.text) for r in readers.read_documents(spark, str(tmp_path)).collect()} == {("log", "plain"), ("md", "# b")}
    assert [r.kind for r in readers.read_documents(spark, str(tmp_path), ("md",)).collect()] == ["md"]
