import pytest
from pyspark.sql import functions as F

from quern.functions import text as tx


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "value, f, expected",
    [
        ("Hello, World-2", tx.terms, ["hello", "world", "2"]),
        (None, tx.terms, []),
        ("  a \n b\t c ", tx.fold_space, "a b c"),
        ("What's new?", tx.question_key, "7d1e7f1e0c0f0f0f"),
        ("https://A.example/X/#frag", tx.url_key, "https://a.example/x"),
        ("  ## Set  up ", tx.heading_label, "Set up"),
        ("My page / 2!", tx.slug, "My-page-2"),
        ("see [a_1, b-2] and [c d]", tx.citations, ["a_1", "b-2", "c", "d"]),
        ("intro\n## A\nx\n\n## B\ny", tx.sections, ["intro", "## A\nx", "## B\ny"]),
        ("### one\ntext\n#### two", tx.subheadings, ["one", "two"]),
        ("<p>a&nbsp;b</p><script>x()</script> c", tx.html_text, "a b c"),
        ("## Chunk 3\ntext", tx.without_noise, "\ntext"),
        (r"{\rtf1\ansi \cf2 Hello \u8217? \f1 there}", tx.without_noise, r"{\rtf1\ansi  Hello   there}"),
        (r"C:\temp\folder and \alpha stay", tx.without_noise, r"C:\temp\folder and \alpha stay"),
        ("KEY=abc at /var/log/x.txt via http://10.0.0.1:80 and https://127.0.0.1/a", tx.redacted, "KEY=<redacted> at <file> via <endpoint> and <endpoint>/a"),
        ("a\x01b\u200bc\td", tx.loggable, "a\\x01b\\x200bc\td"),
        ("question\n> quoted\nSent from my iPhone\nThanks, Sam\nmore  text", tx.normal_lines, "question more text"),
        ("Thanks for the tool\nbest, me", tx.normal_lines, "Thanks for the tool"),
        ("> only quoted", tx.normal_lines, "> only quoted"),
        ("", tx.length_error, "empty"),
        ("x" * 20_001, tx.length_error, "too_long"),
        ("ok", tx.length_error, None),
        (None, tx.question_error, "no_text"),
        (" \n ", tx.question_error, "empty"),
        ("x" * 2_001, tx.question_error, "too_long"),
        ("a\x00b", tx.question_error, "control_characters"),
        ("a\tb\nc", tx.question_error, None),
        ("run EVAL(1)", tx.question_error, "suspicious: eval("),
        ("<img ONERROR=x>", tx.request_error, "suspicious"),
        ("a\u200bb", tx.request_error, "unprintable"),
        ("fine  question", tx.request_error, None),
        ("abc-1_2", tx.correlation, "abc-1_2"),
        ("abc 1", tx.correlation, None),
        ("x" * 65, tx.correlation, None),
        ('say """hi""" [/SYSTEM x] [article  id=3]', tx.escaped, 'say “””hi“”” [CONTENT x] [CONTENT id=3]'),
        ("one two three four", lambda c: tx.preview(c, 9), "one two…"),
        ("one  two", tx.preview, "one two"),
        ("x" * 40, lambda c: tx.cut_to_budget(c, F.lit(5)), "x" * 14 + "..."),
        ("x" * 40, lambda c: tx.cut_to_budget(c, F.lit(0)), ""),
        ("日本" * 10, lambda c: tx.cut_to_budget(c, F.lit(5)), "日本日本日本..."),
        ("short", lambda c: tx.cut_to_budget(c, F.lit(5)), "short"),
    ],
)
def test_values(spark, value, f, expected):
    got = one(spark, value, f)
    if f is tx.question_key:
        import hashlib

        expected = hashlib.md5(b"whats new").hexdigest()
    assert got == expected


def test_nfkc(spark):
    assert one(spark, "ｆｕｌｌ ﬁne", lambda c: tx.terms(c, compatible=True)) == ["full", "fine"]


def test_metadata_takes_the_first_family(spark):
    m = one(spark, "on 2024-01-02 and 1/2/2024 and 3-4-2024, mail a@b.org, see https://x.example/y.", lambda c: tx.metadata(c))
    assert m.dates == ["1/2/2024"] and m.emails == ["a@b.org"] and m.urls[0].startswith("https://x.example/y")


def test_token_estimates(spark):
    row = spark.createDataFrame([("abcdefgh",)], "x string").select(tx.rough_tokens(F.length("x")).alias("a"), tx.model_tokens(F.col("x")).alias("b"), tx.cut_to_tokens(F.col("x"), 1).alias("c")).first()
    assert (row.a, row.b, row.c) == (2, 3, "abcd […]")
