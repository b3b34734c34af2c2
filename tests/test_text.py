"""Scalar column functions against hand-written cases (FIXTURES.md part D)."""

from pyspark.sql import functions as F

from quillrank.functions.html import html_code_blocks, html_to_text, html_without_code
from quillrank.functions.text import (judge_struct, parse_rewrites, safe_int, tags_to_array,
                                      truncate_tokens)


def one_col(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_safe_int(spark):
    vals = ["", "12", "12.9", "-3.7", "1e3", " 7 ", "nan", "inf", "abc", "1.0d", None, "1_000"]

    def py(v):
        try:
            return int(float(str(v)))
        except Exception:
            return 0
    expected = [py(v) for v in vals]
    expected[-1] = 0  # '1_000': Python reads 1000; the engine treats it as text (documented)
    expected[-2] = 0  # None -> 'None' -> 0
    assert one_col(spark, vals, safe_int) == expected


def test_html_to_text(spark):
    cases = {
        "a<b>b</b>": "a b",
        "&amp;lt;": "&lt;",
        "x&nbsp;y": "x y",
        "<script>var t='</p>';</script>keep": "keep",
        "<!-- a > b -->text": "text",
        "<style>p{}</style> <p>one\n\n two</p>": "one two",
        "&#65;&#x42;": "AB",
    }
    got = one_col(spark, list(cases), html_to_text)
    assert got == list(cases.values())


def test_code_blocks(spark):
    html = ("<p>intro</p><pre><code>x = 1\n  y = <b>2</b>\n</code></pre><p>mid <code>inline</code>"
            "</p><pre>second</pre>")
    blocks = one_col(spark, [html], html_code_blocks)[0]
    assert blocks == ["x = 1\n  y = 2", "second"]
    prose = one_col(spark, [html], lambda c: html_to_text(html_without_code(c)))[0]
    assert prose == "intro [CODE] mid inline [CODE]"


def test_truncate(spark):
    got = one_col(spark, ["a b c", "a b c d", "a  b"], lambda c: truncate_tokens(c, 3))
    assert got == ["a b c", "a b c", "a  b"]


def test_tags(spark):
    got = one_col(spark, ["<python><async-io>", "|python|x|", "", None], tags_to_array)
    assert got == [["python", "async-io"], ["|python|x|"], [], []]


def test_parse_rewrites(spark):
    df = spark.createDataFrame([
        ('["a"," b "]',), ("[]",), ('["",""]',), ("not json",), ('```json\n["x"]\n```',),
    ], "raw string").withColumn("q", F.lit("orig question"))
    got = [r[0] for r in df.select(parse_rewrites(F.col("raw"), F.col("q"))).collect()]
    assert got == [["a", "b"], ["orig question"], [], ["orig question"], ["x"]]


def test_parse_judge(spark):
    raws = ['{"relevance": 4.7, "accuracy": 0.5, "completeness": 9}',
            '{"relevance": -2, "accuracy": "3"}', "bad json", "[1]",
            '```json\n{"relevance": 5, "reasoning": "r"}\n```']
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    got = [tuple(r) for r in df.select(judge_struct(F.col("raw")).alias("j")).select("j.*").collect()]
    assert got == [(4, 1, 5, None), (1, 3, None, None), (None, None, None, "judge error"),
                   (None, None, None, "judge error"), (5, None, None, "r")]
