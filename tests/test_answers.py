import json

import pytest

from quern.functions.answers import parse_answers

CASES = {
    "plain": '{"answer": " Open it. ", "intent": "BILLING", "user_role_inferred": "admin", "security_sensitivity": "high", "answer_style": "", "short_intent_summary": 5, "sources_used": ["a", 2, 2.5, "", null, ["x"]], "needs_human_escalation": true, "reasoning": " because ", "confidence": 85.7}',
    "fence": '```json\n{"answer": "x", "sources": ["s"], "sources_used": []}\n```',
    "open_fence": '```json\n{"answer": "x"}',
    "defaults": '{"intent": "dance", "needs_human_escalation": "yes", "reasoning": 3, "sources_used": "a"}',
    "list": "[1, 2]",
    "text": "no json here",
    "broken": '{"answer": "x',
    "more": '{"answer": "x"} and more',
    "two": '{"answer": "x"},{"answer": "y"}',
}


def test_contract(spark):
    df = spark.createDataFrame([(k, v) for k, v in CASES.items()] + [("null", None)], "k string, raw string").selectExpr("*", "1 as valid", "2 as v")
    got = {r.k: r for r in parse_answers(df, "k", "raw").collect()}
    assert set(got) == set(CASES)
    r = got["plain"]
    assert (r.answer, r.intent, r.user_role, r.security, r.answer_style, r.summary, r.sources, r.escalation, r.reasoning, r.confidence) == ("Open it.", "billing", "admin", "high", "ticket_reply", "5", ["a", "2", "2.5"], True, "because", 86)
    assert (got["fence"].answer, got["fence"].sources) == ("x", ["s"]) and got["open_fence"].answer == "x"
    d = got["defaults"]
    assert (d.answer, d.intent, d.user_role, d.security, d.answer_style, d.summary, d.sources, d.escalation, d.reasoning, d.confidence) == (CASES["defaults"], "other", "unknown", "medium", "ticket_reply", "", [], False, None, None)
    assert all(not got[k].valid and got[k].answer is None and got[k].confidence is None for k in ("list", "text", "broken", "more", "two"))


@pytest.mark.parametrize("value, expected", [(85, 85), (85.7, 86), (0.4, 0), (99.6, 100), ("75", 75), ("75.5", 76), (150, None), (-5, None), ("high", None), (None, None), (False, 0), (True, 1), ([85], None), ({"value": 85}, None), (0.5, 0), (1.5, 2), ("7f", None), (" 7 ", 7)])
def test_confidence(spark, value, expected):
    df = spark.createDataFrame([(1, json.dumps({"answer": "x", "confidence": value}))], "k int, raw string")
    assert parse_answers(df, "k", "raw").first().confidence == expected
