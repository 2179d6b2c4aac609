"""Column functions on text: tokens, clean-up, splitting helpers, token estimates."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TERM = "[a-z0-9]+"
CJK = r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"
#: White space in both of the engines that texts are compared on, and what stands at the ends of a text.
WS = r"[\s\x{0b}\x{85}\p{Z}]"
# Patterns of date families in order of preference, of urls and of e-mail addresses.
DATES = (r"\b\d{1,2}/\d{1,2}/\d{4}\b", r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d{1,2}-\d{1,2}-\d{4}\b")
URL = r'https?://[^\s<>"{}|\\^`\[\]]+'
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
# What is taken out of messages shown to clients, in order, and what stands there instead.
REDACTIONS = (
    (r"http://[\d.:]+", "<endpoint>"),
    (r"https://[\d.:]+", "<endpoint>"),
    (r"[/\\][\p{L}\p{N}_/\\.-]+\.[\p{L}\p{N}_]+", "<file>"),
    (r"[A-Z]:[/\\][\p{L}\p{N}_/\\.-]+", "<file>"),
    (r"([\p{L}\p{N}_]+)=([^\s\p{Z}]+)", "$1=<redacted>"),
)
# Escapes of rich text that count, and those that are taken out, in order.
RTF_WORDS = r"\\(?:cf\d+|u[+-]?\d+\?|f\d+|pard)\b"
RTF_ESCAPES = (r"\\cf\d+", r"\\u[+-]?\d+\?", r"\\f\d+", r"\{\\\*[^}]*\}", r"\\pard\b[^\n]*")
# What a question may not hold, for the pipeline and for the request check, in order.
SUSPICIOUS = ("<script", "javascript:", "eval(", "exec(", "__import__", "<?php")
SUSPICIOUS_REQUEST = ("<script", "javascript:", "onerror=", "onload=", "<iframe", "eval(", "expression(")
#: What does not print, tabs and spaces aside.
UNPRINTED = r"[\x00-\x08\x0a-\x1f\x7f-\x{9f}\x{a0}\x{ad}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\p{Cf}\p{Co}\p{Zl}\p{Zp}]"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility form; Spark has no such function."""
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def terms(text: Column, compatible: bool = False) -> Column:
    """Terms of a text: runs of a-z and 0-9 in lower case; null text has none. `compatible` brings it to NFKC first."""
    low = F.lower(text)
    return F.coalesce(F.regexp_extract_all(nfkc(low) if compatible else low, F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def fold_space(text: Column) -> Column:
    """Trimmed, with every run of white space as one space."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fold_blanks(text: Column) -> Column:
    """Runs of spaces and tabs as one space, trimmed."""
    return F.trim(F.regexp_replace(text, "[ \t]+", " "))


def match_key(text: Column) -> Column:
    """Lower case with single spaces: the key by which labels are matched."""
    return F.lower(fold_space(text))


def question_key(text: Column) -> Column:
    """md5 of a question in lower case without punctuation and with single spaces: the key of the FAQ cache."""
    return F.md5(fold_space(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", "")))


def url_key(url: Column) -> Column:
    """A url without fragment and trailing slashes, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "/+$", ""))


def slug(text: Column) -> Column:
    """What is not a letter, digit, underscore or hyphen becomes a hyphen; none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_-]+", "-"), "^-+|-+$", "")


def heading_label(text: Column) -> Column:
    """A heading without its marks, with single spaces."""
    return fold_space(F.regexp_replace(text, r"^\s*#+\s*", ""))


def sections(body: Column) -> Column:
    """A body split before its second-level headings, trimmed, without empty parts."""
    return F.filter(F.transform(F.split(body, "\n(?=## +)"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")


def subheadings(body: Column) -> Column:
    """Third- and fourth-level headings in order."""
    return F.transform(F.regexp_extract_all(body, F.lit(r"(?m)^[ \t]*#{3,4}[ \t]+(.+)$"), F.lit(1)), lambda x: F.trim(x))


def is_rtf(text: Column) -> Column:
    """An RTF signature in the first 128 characters, or more than 20 of the listed control words in the first 4,096."""
    return F.left(text, F.lit(128)).contains("\\rtf") | (F.regexp_count(F.left(text, F.lit(4096)), F.lit(RTF_WORDS)) > 20)


def without_noise(text: Column) -> Column:
    """The listed RTF escapes removed (in RTF only), and lines that only number a chunk."""
    plain = text
    for pattern in RTF_ESCAPES:
        plain = F.regexp_replace(plain, pattern, "")
    return F.regexp_replace(F.when(is_rtf(text), plain).otherwise(text), r"(?md)^## +Chunk +\d+\s*$", "")


def metadata(text: Column) -> Column:
    """Struct of dates (of the first family that occurs), up to five urls and up to five e-mail addresses."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in DATES]
    none = F.array().cast("array<string>")
    dates = F.coalesce(*(F.when(F.size(f) > 0, f) for f in found), none)
    return F.struct(dates.alias("dates"), F.slice(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), 1, 5).alias("urls"), F.slice(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), 1, 5).alias("emails"))


def html_text(html: Column) -> Column:
    """Readable text of markup: no scripts, styles, comments and tags, single spaces."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]+>", " ")
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(mark))
    return fold_space(bare)


def redacted(message: Column) -> Column:
    """A message without secrets, urls, paths, addresses and pointers."""
    for pattern, instead in REDACTIONS:
        message = F.regexp_replace(message, pattern, instead)
    return message


def loggable(text: Column, most: int = 1000) -> Column:
    """What does not print as hex escapes (tabs stay), cut to `most` characters with an ellipsis."""
    def shown(c: Column) -> Column:
        code = F.lower(F.hex(F.ascii(c)))
        return F.when(c.rlike(UNPRINTED), F.concat(F.lit("\\x"), F.when(F.length(code) < 2, F.lpad(code, 2, "0")).otherwise(code))).otherwise(c)

    safe = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), shown), "")
    whole = F.when(text.rlike(UNPRINTED), safe).otherwise(text)
    return F.when(F.length(whole) > most, F.concat(F.left(whole, F.lit(most)), F.lit("..."))).otherwise(whole)


def citations(answer: Column) -> Column:
    """Identifiers inside square brackets, in order."""
    groups = F.regexp_extract_all(answer, F.lit(r"\[([^\]]+)\]"), F.lit(1))
    return F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit("[a-zA-Z0-9_-]+"), F.lit(0))))


def rough_tokens(characters: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(characters / 4)).cast("bigint")


def model_tokens(text: Column) -> Column:
    """Estimate for mixed scripts: 1.5 characters a token in CJK, 3.5 elsewhere, rounded up."""
    cjk = F.regexp_count(text, F.lit(CJK))
    return F.ceil(cjk / 1.5 + (F.length(text) - cjk) / 3.5).cast("bigint")


def cut_to_tokens(text: Column, budget: int) -> Column:
    """At most `budget` tokens by the four-character rule, with a mark where something is missing."""
    return F.when(F.length(text) <= 4 * budget, text).otherwise(F.concat(F.left(text, F.lit(4 * budget)), F.lit(" […]")))


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def collapsed(text: Column) -> Column:
    """Stripped, with every run of white space as one space."""
    return stripped(F.regexp_replace(text, f"{WS}+", " "))


def normal_lines(text: Column) -> Column:
    """A ticket as one line: without blank, quoted and device lines, lines of 60 and more base64 characters, and thanks and regards after the first line that is kept; the text itself where nothing remains."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), stripped)
    plain = F.filter(lines, lambda x: (x != "") & ~F.lower(x).rlike("sent from my (?:iphone|android)") & ~x.startswith(">") & ~x.rlike(r"^[A-Za-z0-9+/=]{60,}$"))
    kept = F.filter(plain, lambda x, i: (i == 0) | ~F.lower(x).rlike("^(?:thanks|thank you|best,|regards,)"))
    joined = stripped(F.regexp_replace(F.array_join(kept, " "), f"{WS}{{2,}}", " "))
    return F.when(joined != "", joined).otherwise(stripped(text))


def length_error(question: Column, most: int = 20_000) -> Column:
    """empty, too_long or null: the first check of a question."""
    return F.when(question.isNull() | (question == ""), "empty").when(F.length(question) > most, "too_long")


def question_error(question: Column, most: int = 2_000) -> Column:
    """What the pipeline refuses a question for: no_text, empty, too_long, control_characters, or the suspicious pattern; else null."""
    q = stripped(question)
    found = F.when(question.isNull(), "no_text").when(q == "", "empty").when(F.length(q) > most, "too_long").when(q.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), "control_characters")
    for pattern in SUSPICIOUS:
        found = found.when(F.lower(q).contains(pattern), f"suspicious: {pattern}")
    return found


def request_error(question: Column) -> Column:
    """What the request check refuses a question for: empty, suspicious, unprintable; else null."""
    q = collapsed(question)
    bad = F.lit(False)
    for pattern in SUSPICIOUS_REQUEST:
        bad = bad | F.lower(q).contains(pattern)
    return F.when(question.isNull() | (q == ""), "empty").when(bad, "suspicious").when(q.rlike(r"[\p{Cc}\p{Cf}\p{Co}]"), "unprintable")


def correlation(raw: Column, most: int = 64) -> Column:
    """A correlation id of letters, digits, underscores and hyphens, at most `most` of them; else null."""
    return F.when(raw.rlike(r"\A[a-zA-Z0-9_-]+\z") & (F.length(raw) <= most), raw)


def escaped(text: Column) -> Column:
    """A chunk's text that cannot end its block in a prompt or start another."""
    text = F.replace(text, F.lit('"""'), F.lit("“””"))
    text = F.regexp_replace(text, r"(?i)\[ARTICLE\s+id=", "[CONTENT id=")
    text = F.regexp_replace(text, r"(?i)\[/?CONTEXT\s*", "[CONTENT ")
    return F.regexp_replace(text, r"(?i)\[/?SYSTEM\s*", "[CONTENT ")


def snippet_header(id_: Column, title: Column, section: Column, url: Column) -> Column:
    """[id | title | section], with the url on a line below where there is one; missing parts are written None."""
    part = lambda c: F.coalesce(c, F.lit("None"))
    head = F.concat(F.lit("["), part(id_), F.lit(" | "), part(title), F.lit(" | "), part(section), F.lit("]"))
    return F.concat(head, F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit("\n"), url)).otherwise(F.lit("")))


def preview(text: Column, width: int = 140) -> Column:
    """A text on one line, cut at a word boundary to `width` characters, an ellipsis for what is missing."""
    line = collapsed(text)
    cut = F.regexp_extract(F.left(line, F.lit(width)), r"^(.*?) *(?:\S*)$", 1)
    return F.when(F.length(line) <= width, line).otherwise(F.concat(stripped(F.when(F.substring(line, width, 1) == " ", F.left(line, F.lit(width - 1))).otherwise(cut)), F.lit("…")))


def cut_to_budget(text: Column, budget: Column) -> Column:
    """The longest start of a text within `budget` tokens by `model_tokens`, an ellipsis where something is missing and the budget has room for it.

    A start's estimate grows with its characters, so the longest one is found
    from the running weights: CJK characters weigh 2/3, others 2/7 of a token.
    """
    ellipsis = 1  # tokens of three dots: the rounded-up 3/3.5
    room = F.when(budget < ellipsis, budget).otherwise(budget - ellipsis)
    characters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    cjk = F.transform(characters, lambda c: F.when(c.rlike(CJK), 1).otherwise(0))
    fit = F.aggregate(
        cjk,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("c"), F.lit(0).alias("best")),
        lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["c"] + x).alias("c"), F.when(F.ceil((a["c"] + x) / 1.5 + (a["n"] + 1 - a["c"] - x) / 3.5) <= room, a["n"] + 1).otherwise(a["best"]).alias("best")),
        lambda a: a["best"],
    )
    plain = F.greatest(F.lit(0), F.floor(room * 3.5)).cast("int")
    start = F.left(text, F.when(text.rlike(CJK), fit).otherwise(plain))
    return F.when(model_tokens(text) <= budget, text).when(budget < ellipsis, start).otherwise(F.concat(start, F.lit("...")))
