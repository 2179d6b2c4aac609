"""Structured answers of a model: taking the JSON contract apart, with its defaults and coercions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as tx

# What the contract's fields may hold.
INTENTS = ("feature_howto", "troubleshooting", "account_security", "billing", "workspace_admin", "workspace_member", "data_privacy", "screenshots_troubleshooting", "other")
ROLES = ("admin", "manager", "regular_member", "external_client", "unknown")
SECURITY = ("low", "medium", "high")


def unfenced(raw: Column) -> Column:
    """An answer without the code fence around it: first and last line where the last one closes the fence, else the first line and every fence mark."""
    t = tx.stripped(raw)
    lines = F.split(t, "\n")
    n = F.size(lines)
    fenced = t.startswith("```")
    closed = fenced & (n >= 3) & (tx.stripped(F.element_at(lines, -1)) == "```")
    inner = F.array_join(F.slice(lines, F.lit(2), F.greatest(n - 2, F.lit(0))), "\n")
    rest = F.replace(F.array_join(F.slice(lines, F.lit(2), F.greatest(n - 1, F.lit(0))), "\n"), F.lit("```"), F.lit(""))
    return F.when(closed, tx.stripped(inner)).when(fenced & (n >= 2), tx.stripped(rest)).otherwise(t)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _string(v: Column, default: Column) -> Column:
    """Text of a scalar: strings trimmed, numbers and booleans written out; anything else is the default."""
    kind = _kind(v)
    text = F.try_variant_get(v, "$", "string")
    number = F.try_variant_get(v, "$", "double").cast("string")
    return (
        F.when(kind == "STRING", tx.stripped(text))
        .when(kind == "BOOLEAN", F.initcap(text))
        .when(kind == "BIGINT", text)
        .when(kind.rlike("^(?:DECIMAL|DOUBLE|FLOAT)"), number)
        .otherwise(default)
    )


def _strings(v: Column) -> Column:
    """The scalars of a list as trimmed texts, blank ones and others left out; no list gives none."""
    items = F.when(_kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    texts = F.transform(items, lambda x: _string(x, F.lit("")))
    return F.coalesce(F.filter(texts, lambda x: x != ""), F.array().cast("array<string>"))


def _percent(v: Column) -> Column:
    """A number from 0 to 100, also one in a string or a boolean, rounded half to even; else null."""
    kind = _kind(v)
    text = F.try_variant_get(v, "$", "string")
    number = (
        F.when(kind == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), 1.0).otherwise(0.0))
        .when(kind.rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double"))
        .when((kind == "STRING") & text.rlike(r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"), F.trim(text).try_cast("double"))
    )
    return F.when(number.between(0.0, 100.0), F.bround(number, 0).cast("int"))


def parse_answers(df: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, valid, answer, intent, user_role, security, answer_style, summary, sources, escalation, reasoning, confidence) of raw model answers.

    `valid`: the text, a code fence aside, is one JSON object; else all other
    fields are null. Enumerated fields fall back to `other`, `unknown` and
    `medium`, an answer that is missing to the text itself; escalation counts
    only where it is a boolean; `sources` stands in for an empty
    `sources_used`. Null texts give no row; extra columns are ignored.
    """
    rows = df.where(F.col(raw).isNotNull()).select(F.col(key).alias("k"), unfenced(F.col(raw)).alias("t"))
    # the parser stops behind a first value: a mark behind the text tells whether that was all of it
    rows = rows.select("k", "t", F.try_parse_json(F.concat(F.lit('{"value":'), "t", F.lit(',"!end":0}'))).alias("w"))
    value = F.when(F.try_variant_get("w", "$['!end']", "int") == 0, F.try_variant_get("w", "$.value", "variant"))
    rows = rows.select("k", "t", value.alias("v"))
    rows = rows.select("k", "t", F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v")).alias("v"))
    fields = ("answer", "intent", "user_role_inferred", "security_sensitivity", "answer_style", "short_intent_summary", "sources_used", "sources", "needs_human_escalation", "reasoning", "confidence")
    rows = rows.select("k", "t", F.col("v").isNotNull().alias("valid"), *(F.try_variant_get("v", f"$.{f}", "variant").alias(f"f_{f}") for f in fields))
    f = lambda name: F.col(f"f_{name}")

    def one_of(value: Column, known: tuple[str, ...], default: str) -> Column:
        low = F.lower(value)
        return F.when(low.isin(*known), low).otherwise(default)

    style = _string(f("answer_style"), F.lit("ticket_reply"))
    used, other = _strings(f("sources_used")), _strings(f("sources"))
    out = {
        "answer": _string(f("answer"), F.col("t")),
        "intent": one_of(_string(f("intent"), F.lit("other")), INTENTS, "other"),
        "user_role": one_of(_string(f("user_role_inferred"), F.lit("unknown")), ROLES, "unknown"),
        "security": one_of(_string(f("security_sensitivity"), F.lit("medium")), SECURITY, "medium"),
        "answer_style": F.when(style == "", "ticket_reply").otherwise(style),
        "summary": _string(f("short_intent_summary"), F.lit("")),
        "sources": F.when(F.size(used) > 0, used).otherwise(other),
        "escalation": F.when(_kind(f("needs_human_escalation")) == "BOOLEAN", F.try_variant_get(f("needs_human_escalation"), "$", "boolean")).otherwise(False),
        "reasoning": F.when(_kind(f("reasoning")) == "STRING", tx.stripped(F.try_variant_get(f("reasoning"), "$", "string"))),
        "confidence": _percent(f("confidence")),
    }
    return rows.select(F.col("k").alias(key), "valid", *(F.when(F.col("valid"), c).alias(n) for n, c in out.items()))
