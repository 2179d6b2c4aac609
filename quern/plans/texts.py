"""Registered queries on texts, questions and answers, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions.answers import parse_answers
from quern.operators import references as rf
from quern.operators.chunking import boundary_pieces, build_chunks, character_windows, chunk_id
from quern.plans.retrieval import chunk_rows, table


def _responses(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "query_responses")


def query_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Tickets as one line, and what is left of their white space."""
    q = tx.normal_lines(F.col("question"))
    return _responses(spark, folder).where("question is not null").select("response_id", q.alias("question"))


def question_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What each of the three question checks says, the question with single spaces, and the correlation id where it is a safe one."""
    q = F.col("question")
    return _responses(spark, folder).select("response_id", tx.length_error(q).alias("length_error"), tx.question_error(q).alias("question_error"), tx.request_error(q).alias("request_error"), tx.collapsed(q).alias("cleaned"), tx.correlation(F.col("correlation_id")).alias("correlation_id"))


def char_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return character_windows(table(spark, folder, "documents"), "doc_id", "text", 1600, 200).select("doc_id", "window", "start", F.length("piece").alias("n"), F.md5("piece").alias("digest"))


def chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chunks").where("doc_name is not null and text is not null and section_idx is not null and chunk_idx is not null")
    return rows.select("id", chunk_id(F.col("doc_name"), F.col("section_idx"), F.col("chunk_idx"), F.col("text")).alias("made")).distinct()


def heading_split(spark: SparkSession, folder: str) -> DataFrame:
    """The second-level sections of every document with their heading and size."""
    rows = table(spark, folder, "documents").where("text is not null")
    rows = rows.select("doc_id", F.posexplode(tx.sections(F.col("text"))).alias("section", "body"))
    return rows.select("doc_id", "section", tx.heading_label(F.regexp_extract("body", "^(##[^\n]*)", 1)).alias("heading"), F.length("body").alias("n"))


def ingest_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """All chunks built from the documents; a block that is too long is cut into windows, as no sentence model is at hand."""
    docs = table(spark, folder, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")
    return build_chunks(docs, sentences=False).select("id", "section", "subsection", "section_idx", "chunk_idx", "char_count", "word_count", F.col("metadata.section_importance").alias("importance"), F.md5("text").alias("digest"))


def sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The documents in pieces of at most 1,600 characters, blocks that are too long being packed from their sentences."""
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(boundary_pieces(F.col("text"))).alias("place", "piece"))
    return rows.select("doc_id", "place", F.length("piece").alias("n"), F.md5("piece").alias("digest"))


def metadata_extract(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", tx.metadata(F.col("text")).alias("m"))
    return rows.select("doc_id", F.array_join("m.dates", "|").alias("dates"), F.array_join("m.urls", "|").alias("urls"), F.array_join("m.emails", "|").alias("emails"))


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Estimates of a document's tokens, and how long it is when cut to 128 of them by either estimate."""
    t = F.col("text")
    return table(spark, folder, "documents").where("text is not null").select("doc_id", tx.rough_tokens(F.length(t)).alias("rough"), tx.model_tokens(t).alias("model"), F.length(tx.cut_to_tokens(t, 128)).alias("cut"), F.length(tx.cut_to_budget(t, F.lit(128))).alias("fitted"))


def noise_stripped(spark: SparkSession, folder: str) -> DataFrame:
    t = tx.without_noise(F.col("text"))
    return table(spark, folder, "documents").where("text is not null").select("doc_id", tx.is_rtf(F.col("text")).alias("rtf"), F.length(t).alias("n"), F.md5(t).alias("digest"))


def escaped_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Per chunk its header in a prompt, its preview, and its text without marks that could end a prompt block."""
    rows = chunk_rows(spark, folder, text=True)
    safe = tx.escaped(F.coalesce("text", F.lit("")))
    return rows.select("id", tx.snippet_header(F.col("id"), F.col("title"), F.col("section"), F.col("url")).alias("header"), tx.preview(F.coalesce("text", F.lit(""))).alias("preview"), F.length(safe).alias("n"), F.md5(safe).alias("digest"))


def chunk_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The article and section keys that deduplication, diversity and packing group by."""
    return chunk_rows(spark, folder).select("id", "article_key", "section_key")


def citations_validate(spark: SparkSession, folder: str) -> DataFrame:
    """Citations in an answer, and those of them that are among its sources."""
    rows = _responses(spark, folder).where("answer is not null").select("response_id", tx.citations(F.col("answer")).alias("c"), F.coalesce("sources", F.array().cast("array<string>")).alias("s"))
    valid = F.filter("c", lambda x: F.array_contains("s", x))
    return rows.where(F.size("c") > 0).select("response_id", F.size("c").alias("cited"), F.size(valid).alias("valid"), F.array_join(F.array_distinct(valid), "|").alias("ids"))


def answer_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """The ten fields of the answer contract of every answer that is one JSON object; others are marked."""
    rows = parse_answers(_responses(spark, folder), "response_id", "answer")
    return rows.withColumn("sources", F.array_join("sources", "|"))


def _urls(spark: SparkSession, folder: str) -> DataFrame:
    """(response_id, url, direct): urls given as a source themselves, and those of the chunks given as a source."""
    used = _responses(spark, folder).select("response_id", F.explode("sources").alias("source")).withColumn("source", tx.stripped(F.col("source")))
    direct = used.where(F.lower("source").startswith("http")).select("response_id", F.col("source").alias("url"), F.lit(True).alias("direct"))
    chunks = chunk_rows(spark, folder).where("url <> ''").select(F.col("id").alias("source"), "url")
    return direct.union(used.join(chunks, "source").select("response_id", "url", F.lit(False)))


def source_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Per response the sorted distinct urls of its sources: those given as urls, else those of the chunks."""
    rows = _urls(spark, folder).groupBy("response_id").agg(F.array_sort(F.collect_set(F.when(F.col("direct"), F.col("url")))).alias("d"), F.array_sort(F.collect_set("url")).alias("u"))
    return rows.select("response_id", F.array_join(F.when(F.size("d") > 0, F.col("d")).otherwise(F.col("u")), "|").alias("urls"))


def source_urls_all(spark: SparkSession, folder: str) -> DataFrame:
    """Per response and url of either kind one row."""
    return _urls(spark, folder).select("response_id", "url").distinct()


def response_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """The JSON a client gets: answer, first five sources, whole confidence where it is known, refusal."""
    shown = F.slice(F.coalesce("sources", F.array().cast("array<string>")), 1, 5)
    sure = F.when(F.col("confidence").between(0.0, 100.0), F.bround("confidence", 0).cast("int"))
    body = F.to_json(F.struct("answer", shown.alias("citations"), sure.alias("confidence"), F.coalesce("refused", F.lit(False)).alias("refused")))
    return _responses(spark, folder).select("response_id", F.size(shown).alias("shown"), F.md5(body).alias("digest"))


def citation_details(spark: SparkSession, folder: str) -> DataFrame:
    """The sources of every response in order, as what is shown of a cited chunk; unknown ones fall out."""
    used = _responses(spark, folder).select("response_id", F.posexplode("sources").alias("place", "id"))
    return rf.citation_details(used, chunk_rows(spark, folder))


def source_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Sources named in other spellings, or by the page above, matched with the urls a response had as context.

    The names are made from the urls of the response's own chunks: in capitals
    with a fragment, and cut to the page above.
    """
    context = _responses(spark, folder).select("response_id", F.posexplode("sources").alias("place", "id")).join(chunk_rows(spark, folder).where("url is not null").select("id", "url"), "id").select("response_id", "place", "url")
    spelled = F.array(F.concat(F.upper("url"), F.lit("/#top")), F.regexp_replace("url", "/[^/]*$", ""))
    return rf.match_sources(context.select("response_id", F.explode(spelled).alias("source")).distinct(), context, "response_id")


def chunk_log(spark: SparkSession, folder: str) -> DataFrame:
    """Log rows of the chunks a response had, by rank from 0; unknown ones keep their id."""
    used = _responses(spark, folder).select("response_id", F.posexplode("sources").alias("rank", "id"))
    known = chunk_rows(spark, folder).select("id", "title", "section", "url")
    return used.join(known, "id", "left").select("response_id", "rank", "id", "title", "section", "url")


def sanitize_client(spark: SparkSession, folder: str) -> DataFrame:
    safe = tx.redacted(F.col("answer"))
    return _responses(spark, folder).where("answer is not null").select("response_id", F.length(safe).alias("n"), F.md5(safe).alias("digest"))


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    safe = tx.loggable(F.col("question"), 80)
    return _responses(spark, folder).where("question is not null").select("response_id", safe.alias("line"))


def faq_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Question keys with the number of their responses and the newest response that was not refused."""
    rows = _responses(spark, folder).where("question is not null").select(tx.question_key(F.col("question")).alias("key"), "response_id", F.when(~F.coalesce("refused", F.lit(False)) & F.col("responded_at").isNotNull(), F.struct("responded_at", "response_id")).alias("s"))
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.max("s").alias("s")).where("s is not null").select("key", "n", F.col("s.response_id").alias("response_id"))


# The SQL below is written from the rules themselves, not from the constants of the library.
_W = r"[\s\x{0b}\x{85}\p{Z}]"
_CJK = r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"
_SLUG = r"regexp_replace(regexp_replace(doc_name, '[^A-Za-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g')"
_ONE = """one as (select *, coalesce(nullif(url, ''), nullif(metadata.extra['url'], ''), nullif(metadata.extra['source_url'], ''), nullif(metadata.extra['doc_url'], ''), 'article:' || nullif(article_id, ''), 'article:' || nullif(metadata.extra['article_id'], ''), nullif(doc_name, ''), id) as article_key
  from (select *, row_number() over (partition by id order by coalesce(title, ''), coalesce(section, ''), coalesce(subsection, ''), coalesce(url, ''), coalesce(article_id, ''), coalesce(doc_name, ''), coalesce(section_idx, -1), coalesce(chunk_idx, -1), coalesce(metadata.section_type, ''), coalesce(metadata.breadcrumb, ''), coalesce(metadata.is_hub, false)) as pick from chunks where id is not null) where pick = 1)"""


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"


def _one_space(x: str) -> str:
    return _strip(f"regexp_replace({x}, '{_W}+', ' ', 'g')")


def _has(x: str, words: tuple[str, ...]) -> str:
    return " or ".join(f"contains(lower({x}), '{w}')" for w in words)


_NP = r"[\x{00}-\x{08}\x{0a}-\x{1f}\x{7f}-\x{9f}\x{a0}\x{ad}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\p{Cf}\p{Co}\p{Zl}\p{Zp}]"


def _field(name: str) -> str:
    return f"json_extract(j, '$.{name}')"


def _scalar(x: str, default: str) -> str:
    return f"case json_type({x}) when 'VARCHAR' then {_strip(f'({x}->>' + chr(39) + '$' + chr(39) + ')')} when 'BOOLEAN' then case when {x}::varchar = 'true' then 'True' else 'False' end when 'BIGINT' then {x}::varchar when 'UBIGINT' then {x}::varchar when 'DOUBLE' then {x}::double::varchar else {default} end"


def _list(name: str) -> str:
    return f"""case when json_type({_field(name)}) = 'ARRAY' then list_filter(list_transform(json_extract(j, '$.{name}[*]'), lambda x: {_scalar('x', "''")}), lambda x: x <> '') else [] end"""


def _enum(name: str, known: str, default: str) -> str:
    x = _scalar(_field(name), f"'{default}'")
    return f"case when lower({x}) in ({known}) then lower({x}) else '{default}' end"


# Long texts without lines that number a chunk, their one sign that has another compatible form written out; none is rich text, none holds marked articles.
_PLAIN = r"regexp_replace(replace(regexp_replace({}, '(?m)^## +Chunk +\d+\s*$', '', 'g'), '™', 'TM'), '[ \t]+', ' ', 'g')"


def _units(x: str) -> str:
    starts = rf"(\n{_W}*\n|\n{_W}*[-*]{_W}+|\n{_W}*\p{{Nd}}+\.{_W}+|\n#{{2,}}{_W}+)"
    return f"list_filter(string_split(regexp_replace({x}, '{starts}', chr(1) || '\\1', 'g'), chr(1)), lambda x: {_strip('x')} <> '')"


_LABEL = f"regexp_replace(split_part(body, chr(10), 1), '^#+{_W}*', '')"
_PACKED = "case when len(u) > 0 then list_reduce(list_transform(u, lambda x: {'done': []::varchar[], 'now': x}), lambda a, x: case when a.now <> '' and length(a.now) + length(x.now) > 1600 then {'done': list_append(a.done, a.now), 'now': x.now} else {'done': a.done, 'now': a.now || x.now} end) end"
_WINDOWS = f"list_filter(list_transform(range(0, cast(ceil((length(x.s) - 200) / 1400.0) as bigint)), lambda w: {_strip('substr(x.s, w * 1400 + 1, 1600)')}), lambda y: y <> '')"
_FULL = "len(a.now) > 0 and length(array_to_string(a.now, ' ')) + 1 + length(x.s) > 1600"
_CLOSED = "case when len(a.now) > 0 then list_append(a.done, array_to_string(a.now, ' ')) else a.done end"
_TAIL = "a.now[len(a.now) + 1 - len(list_filter(range(1, len(a.now) + 1), lambda j: length(array_to_string(a.now[-j:], ' ')) <= least(200, 1599 - length(x.s)))):]"
_SENTENCES = f"""list_reduce(list_transform(list_filter(string_split(regexp_replace(piece, '([.!?]){_W}+', '\\1' || chr(1), 'g'), chr(1)), lambda y: y <> ''), lambda y: {{'done': []::varchar[], 'now': []::varchar[], 's': y}}),
  lambda a, x: {{'done': case when length(x.s) > 1600 then list_concat({_CLOSED}, {_WINDOWS}) when {_FULL} then {_CLOSED} else a.done end, 'now': case when length(x.s) > 1600 then []::varchar[] when {_FULL} then list_append({_TAIL}, x.s) else list_append(a.now, x.s) end, 's': ''}}, {{'done': []::varchar[], 'now': []::varchar[], 's': ''}})"""
SQL = {
    "query_normalize": rf"""with l as (select response_id, question, list_filter(list_transform(regexp_split_to_array(question, '\r\n|[\n\r\x0b\x0c\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: {_strip('x')}),
        lambda x: x <> '' and not contains(lower(x), 'sent from my iphone') and not contains(lower(x), 'sent from my android') and not starts_with(x, '>') and not regexp_full_match(x, '[A-Za-z0-9+/=]{{60,}}')) as l from query_responses where question is not null),
      k as (select response_id, question, {_strip(f"regexp_replace(array_to_string(list_filter(l, lambda x, i: i = 1 or not regexp_matches(lower(x), '^(?:thanks|thank you|best,|regards,)')), ' '), '{_W}{{2,}}', ' ', 'g')")} as k from l)
      select response_id, case when k <> '' then k else {_strip('question')} end as question from k""",
    "question_checks": rf"""with q as (select response_id, question as q, {_strip('question')} as s, {_one_space('question')} as c, correlation_id from query_responses)
      select response_id, case when q is null or q = '' then 'empty' when length(q) > 20000 then 'too_long' end as length_error,
        case when q is null then 'no_text' when s = '' then 'empty' when length(s) > 2000 then 'too_long' when regexp_matches(s, '[\x00-\x08\x0b\x0c\x0e-\x1f]') then 'control_characters'
          when contains(lower(s), '<script') then 'suspicious: <script' when contains(lower(s), 'javascript:') then 'suspicious: javascript:' when contains(lower(s), 'eval(') then 'suspicious: eval('
          when contains(lower(s), 'exec(') then 'suspicious: exec(' when contains(lower(s), '__import__') then 'suspicious: __import__' when contains(lower(s), '<?php') then 'suspicious: <?php' end as question_error,
        case when c is null or c = '' then 'empty' when {_has('c', ('<script', 'javascript:', 'onerror=', 'onload=', '<iframe', 'eval(', 'expression('))} then 'suspicious' when regexp_matches(c, '[\p{{Cc}}\p{{Cf}}\p{{Co}}]') then 'unprintable' end as request_error,
        c as cleaned, case when regexp_full_match(correlation_id, '[a-zA-Z0-9_-]+') and length(correlation_id) <= 64 then correlation_id end as correlation_id from q""",
    "char_chunks": f"""with d as (select doc_id, text, length(text) as n from documents where text is not null and text <> ''),
      w as (select doc_id, text, unnest(range(0, case when n <= 1600 then 1 else cast(ceil((n-200)/1400.0) as bigint) end)) as w from d),
      p as (select doc_id, w, {_strip('substr(text, w*1400+1, 1600)')} as p from w)
      select doc_id, cast(w as int) as "window", cast(w*1400 as int) as start, length(p) as n, md5(p) as digest from p where p <> ''""",
    "chunk_ids": f"select distinct id, {_SLUG} || '_' || section_idx || '_' || chunk_idx || '_' || left(sha1(text), 8) as made from chunks where doc_name is not null and text is not null and section_idx is not null and chunk_idx is not null",
    "heading_split": r"""with s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\n(## +)', chr(1) || '\1', 'g'), chr(1)), lambda x: regexp_replace(x, '^[\s\x{0b}]+|[\s\x{0b}]+$', '', 'g')), lambda x: x <> '') as s from documents where text is not null),
      u as (select doc_id, unnest(s) as body, generate_subscripts(s, 1) - 1 as section from s)
      select doc_id, cast(section as int) as section, trim(regexp_replace(regexp_replace(regexp_extract(body, '^(##[^\n]*)', 1), '^\s*#+\s*', ''), '\s+', ' ', 'g')) as heading, length(body) as n from u""",
    "ingest_chunks": rf"""with p as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\n(## +)', chr(1) || '\1', 'g'), chr(1)), lambda x: {_strip('x')}), lambda x: x <> '') as p from documents where text is not null),
      s as (select doc_id, unnest(p) as body, generate_subscripts(p, 1) - 1 as section_idx from p),
      h as (select *, {_one_space(_LABEL)} as section, coalesce(trim(regexp_extract_all(body, '(?m)^[ \t]*#{{3,4}}[ \t]+(.+)$', 1)[1]), '') as subsection from s),
      u as (select doc_id, section_idx, section, subsection, body, {_units(_PLAIN.format('body'))} as u from h),
      r as (select * exclude (u), {_PACKED} as r from u),
      l as (select *, case when length(body) <= 1600 then [body] else list_append(r.done, r.now) end as l from r),
      k as (select doc_id, section_idx, section, subsection, {_strip('unnest(l)')} as piece, generate_subscripts(l, 1) as k, length(body) <= 1600 as small, body from l),
      w as (select *, unnest(range(0, case when length(piece) <= 1600 then 1 else cast(ceil((length(piece) - 200) / 1400.0) as bigint) end)) as w from k),
      f as (select doc_id, section_idx, section, subsection, k, w, case when small then body else {_strip('substr(piece, w * 1400 + 1, 1600)')} end as piece from w),
      n as (select *, row_number() over (partition by doc_id, section_idx order by k, w) - 1 as chunk_idx, 'Context: KB' || case when section <> '' and lower(section) <> 'kb' then ' > ' || section else '' end || case when subsection <> '' then ' > ' || subsection else '' end || chr(10) || chr(10) || piece as text from f where piece <> '')
      select doc_id || '_' || section_idx || '_' || chunk_idx || '_' || left(sha1(doc_id || '|' || section_idx || '|' || chunk_idx || '|' || text), 8) as id, section, subsection, cast(section_idx as int) as section_idx, cast(chunk_idx as int) as chunk_idx, length(text) as char_count,
        len(string_split({_one_space('text')}, ' ')) as word_count, case when lower(section) in ('key points', 'limits & gotchas', 'canonical answer') then 'high' when contains(lower(section), 'faq') then 'medium' end as importance, md5(text) as digest from n""",
    "sentence_pieces": f"""with u as (select doc_id, text, {_units(_PLAIN.format('text'))} as u from documents where text is not null and {_strip('text')} <> ''), r as (select doc_id, text, {_PACKED} as r from u),
      l as (select doc_id, length(text) <= 1600 as small, case when length(text) <= 1600 then [text] else list_transform(list_append(r.done, r.now), lambda x: {_strip('x')}) end as l from r),
      k as (select doc_id, small, unnest(l) as piece, generate_subscripts(l, 1) as k from l), q as (select *, case when length(piece) > 1600 then {_SENTENCES} end as q from k where piece <> ''),
      p as (select doc_id, small, k, case when q is null then [piece] when len(q.now) > 0 then list_append(q.done, array_to_string(q.now, ' ')) else q.done end as p from q),
      f as (select doc_id, k, case when small then unnest(p) else {_strip('unnest(p)')} end as piece, generate_subscripts(p, 1) as s from p)
      select doc_id, cast(row_number() over (partition by doc_id order by k, s) - 1 as int) as place, length(piece) as n, md5(piece) as digest from f where piece <> ''""",
    "metadata_extract": r"""with m as (select doc_id, regexp_extract_all(text, '\b\d{1,2}/\d{1,2}/\d{4}\b') as a, regexp_extract_all(text, '\b\d{4}-\d{2}-\d{2}\b') as b, regexp_extract_all(text, '\b\d{1,2}-\d{1,2}-\d{4}\b') as c,
        regexp_extract_all(text, 'https?://[^\s<>"{}|\\^`\[\]]+') as u, regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b') as e from documents where text is not null)
      select doc_id, array_to_string(case when len(a) > 0 then a when len(b) > 0 then b else c end, '|') as dates, array_to_string(u[1:5], '|') as urls, array_to_string(e[1:5], '|') as emails from m""",
    "token_counts": f"""with t as (select doc_id, length(text) as n, len(regexp_extract_all(text, '{_CJK}')) as c from documents where text is not null), m as (select *, cast(ceil(c/1.5::double + (n-c)/3.5::double) as bigint) as model from t)
      select doc_id, cast(greatest(1, floor(n/4)) as bigint) as rough, model, case when n <= 512 then n else 516 end as cut, case when model <= 128 then n else 444 + 3 end as fitted from m""",
    "noise_stripped": r"""with r as (select doc_id, text, contains(left(text, 128), '\rtf') or len(regexp_extract_all(left(text, 4096), '\\(?:cf\d+|u[+-]?\d+\?|f\d+|pard)\b')) > 20 as rtf from documents where text is not null),
      p as (select doc_id, rtf, regexp_replace(case when rtf then regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\cf\d+', '', 'g'), '\\u[+-]?\d+\?', '', 'g'), '\\f\d+', '', 'g'), '\{\\\*[^}]*\}', '', 'g'), '\\pard\b[^\n]*', '', 'g') else text end, '(?m)^## +Chunk +\d+\s*$', '', 'g') as t from r)
      select doc_id, rtf, length(t) as n, md5(t) as digest from p""",
    "escaped_chunks": rf"""with {_ONE}, t as (select id, max(text) as text from chunks where id is not null group by id),
      e as (select one.id, '[' || one.id || ' | ' || coalesce(title, 'None') || ' | ' || coalesce(section, 'None') || ']' || case when coalesce(url, '') <> '' then chr(10) || url else '' end as header, {_one_space("coalesce(t.text, '')")} as line,
        regexp_replace(regexp_replace(regexp_replace(replace(coalesce(t.text, ''), repeat('"', 3), '“””'), '(?i)\[ARTICLE\s+id=', '[CONTENT id=', 'g'), '(?i)\[/?CONTEXT\s*', '[CONTENT ', 'g'), '(?i)\[/?SYSTEM\s*', '[CONTENT ', 'g') as safe from one join t using (id))
      select id, header, case when length(line) <= 140 then line else rtrim(case when line[140] = ' ' then left(line, 139) when position(' ' in left(line, 140)) > 0 then left(line, 140 - position(' ' in reverse(left(line, 140)))) else '' end, ' ') || '…' end as preview, length(safe) as n, md5(safe) as digest from e""",
    "chunk_keys": f"with {_ONE} select id, article_key, article_key || '::' || coalesce(nullif(section, ''), nullif(subsection, ''), nullif(metadata.section_type, ''), '') as section_key from one",
    "citations_validate": r"""with c as (select response_id, coalesce(sources, []) as s, flatten(list_transform(regexp_extract_all(answer, '\[([^\]]+)\]', 1), lambda g: regexp_extract_all(g, '[a-zA-Z0-9_-]+'))) as c from query_responses where answer is not null),
      u as (select response_id, s, unnest(c) as x, generate_subscripts(c, 1) as pos from c where len(c) > 0),
      f as (select response_id, x, min(pos) as pos from u where list_contains(s, x) group by all),
      g as (select response_id, string_agg(x, '|' order by pos) as ids from f group by response_id)
      select response_id, count(*) as cited, count(*) filter (where list_contains(s, x)) as valid, coalesce(any_value(ids), '') as ids from u left join g using(response_id) group by response_id""",
    "answer_envelopes": rf"""with a as (select response_id, {_strip('answer')} as t from query_responses where answer is not null), l as (select *, string_split(t, chr(10)) as l from a),
      c as (select response_id, case when starts_with(t, '```') and len(l) >= 3 and {_strip('l[-1]')} = '```' then {_strip('array_to_string(l[2:-2], chr(10))')} when starts_with(t, '```') and len(l) >= 2 then {_strip("replace(array_to_string(l[2:], chr(10)), '```', '')")} else t end as t from l),
      v as (select response_id, t, case when json_valid(t) and json_type(t) = 'OBJECT' then t::json end as j from c)
      select response_id, j is not null as valid, case when j is not null then {_scalar(_field('answer'), 't')} end as answer,
        case when j is not null then {_enum('intent', "'feature_howto', 'troubleshooting', 'account_security', 'billing', 'workspace_admin', 'workspace_member', 'data_privacy', 'screenshots_troubleshooting', 'other'", 'other')} end as intent,
        case when j is not null then {_enum('user_role_inferred', "'admin', 'manager', 'regular_member', 'external_client', 'unknown'", 'unknown')} end as user_role,
        case when j is not null then {_enum('security_sensitivity', "'low', 'medium', 'high'", 'medium')} end as security,
        case when j is not null then coalesce(nullif({_scalar(_field('answer_style'), "'ticket_reply'")}, ''), 'ticket_reply') end as answer_style,
        case when j is not null then {_scalar(_field('short_intent_summary'), "''")} end as summary,
        case when j is not null then array_to_string(case when len({_list('sources_used')}) > 0 then {_list('sources_used')} else {_list('sources')} end, '|') end as sources,
        case when j is not null then coalesce(json_type({_field('needs_human_escalation')}) = 'BOOLEAN' and {_field('needs_human_escalation')}::varchar = 'true', false) end as escalation,
        case when json_type({_field('reasoning')}) = 'VARCHAR' then {_strip("(j->>'$.reasoning')")} end as reasoning,
        case when try_cast(j->>'$.confidence' as double) between 0 and 100 then cast(round_even(try_cast(j->>'$.confidence' as double), 0) as int) end as confidence from v""",
    "source_urls": f"""with {_ONE}, s as (select response_id, {_strip('unnest(sources)')} as source from query_responses), d as (select response_id, source as url from s where starts_with(lower(source), 'http')),
      k as (select response_id, one.url from s join one on one.id = source where one.url <> ''), a as (select * from d union all select * from k where response_id not in (select response_id from d))
      select response_id, string_agg(distinct url, '|' order by url) as urls from a group by response_id""",
    "source_urls_all": f"""with {_ONE}, s as (select response_id, {_strip('unnest(sources)')} as source from query_responses)
      select response_id, source as url from s where starts_with(lower(source), 'http') union select response_id, one.url from s join one on one.id = source where one.url <> ''""",
    "response_payloads": """with p as (select response_id, answer, coalesce(sources, [])[1:5] as c, case when confidence between 0 and 100 then cast(round_even(confidence, 0) as int) end as sure, coalesce(refused, false) as refused from query_responses)
      select response_id, cast(len(c) as int) as shown, md5('{' || case when answer is null then '' else '"answer":' || to_json(answer)::varchar || ',' end || '"citations":' || to_json(c)::varchar || case when sure is null then '' else ',"confidence":' || sure end || ',"refused":' || refused || '}') as digest from p""",
    "citation_details": f"""with {_ONE}, s as (select response_id, unnest(sources) as id, generate_subscripts(sources, 1) - 1 as place from query_responses)
      select response_id, cast(place as int) as place, id, coalesce(nullif(title, ''), doc_name, '') as title, coalesce(nullif(url, ''), nullif(metadata.extra['source_url'], ''), metadata.extra['url'], '') as url, coalesce(section, '') as section,
        coalesce(metadata.breadcrumb, '') as breadcrumb, coalesce(nullif(article_id, ''), metadata.extra['article_id'], '') as article_id from s join one using (id)""",
    "source_matches": rf"""with {_ONE}, c as (select response_id, unnest(sources) as id, generate_subscripts(sources, 1) - 1 as place from query_responses), v as (select c.response_id, c.place, one.url from c join one using (id) where one.url is not null),
      n as (select distinct response_id, unnest([upper(url) || '/#top', regexp_replace(url, '/[^/]*$', '')]) as source from v), u as (select *, lower(rtrim(split_part(trim(url), '#', 1), '/')) as k from v),
      f as (select response_id, k, min(place) as place, trim(arg_min(url, place)) as url from u where k <> '' group by response_id, k), m as (select n.*, lower(rtrim(split_part(trim(source), '#', 1), '/')) as k from n)
      select response_id, source, url from (select m.response_id, m.source, f.url, row_number() over (partition by m.response_id, m.source order by case when m.k = f.k then 0 else 1 end, f.place) as r
        from m join f on m.response_id = f.response_id and (m.k = f.k or (m.k <> '' and (contains(f.k, m.k) or contains(m.k, f.k))))) where r = 1""",
    "chunk_log": f"with {_ONE}, s as (select response_id, unnest(sources) as id, generate_subscripts(sources, 1) - 1 as rank from query_responses) select response_id, cast(rank as int) as rank, id, title, section, url from s left join one using (id)",
    "sanitize_client": r"""with r as (select response_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(answer, 'http://[\d.:]+', '<endpoint>', 'g'), 'https://[\d.:]+', '<endpoint>', 'g'), '[/\\][\p{L}\p{N}_/\\.-]+\.[\p{L}\p{N}_]+', '<file>', 'g'), '[A-Z]:[/\\][\p{L}\p{N}_/\\.-]+', '<file>', 'g'), '([\p{L}\p{N}_]+)=([^\s\p{Z}]+)', '\1=<redacted>', 'g') as t from query_responses where answer is not null)
      select response_id, length(t) as n, md5(t) as digest from r""",
    "log_lines": rf"""with s as (select response_id, case when regexp_matches(question, '{_NP}') then array_to_string(list_transform(string_split(question, ''), lambda c: case when regexp_matches(c, '{_NP}') then '\x' || format('{{:02x}}', unicode(c)) else c end), '') else question end as t from query_responses where question is not null)
      select response_id, case when length(t) > 80 then left(t, 80) || '...' else t end as line from s""",
    "faq_lookup": r"""with k as (select md5(trim(regexp_replace(regexp_replace(lower(question), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))) as key, response_id, case when not coalesce(refused, false) and responded_at is not null then responded_at end as t from query_responses where question is not null),
      b as (select key, response_id, row_number() over (partition by key order by t desc, response_id desc) as r from k where t is not null)
      select k.key, count(*) as n, any_value(b.response_id) as response_id from k join b on k.key = b.key and b.r = 1 group by k.key""",
}
QUERIES = (query_normalize, question_checks, char_chunks, chunk_ids, heading_split, ingest_chunks, sentence_pieces, metadata_extract, token_counts, noise_stripped, escaped_chunks, chunk_keys, citations_validate, answer_envelopes, source_urls, source_urls_all, response_payloads, citation_details, source_matches, chunk_log, sanitize_client, log_lines, faq_lookup)
