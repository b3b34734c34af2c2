"""HTML that is cut off, quoted or left open: defined results in time linear in the text."""

import time

import pytest
from pyspark.sql import functions as F

from quillrank.functions.html import html_code_blocks, html_to_text, html_without_code


@pytest.mark.parametrize("html, text", [
    ('<p title="a>b">x</p>', "x"),
    ("<p title='a>b' id = \"c>d\">x</p>", "x"),
    ('<p title="a>b', 'b'),                       # never closed: the tag ends at its first >
    ("<a href=x=y>z</a>", "z"),
    ("a < b <c", "a < b <c"),
    ("a <b and c", "a <b and c"),
    ("a<!-- b", "a"), ("a<!-- b --> c", "a c"),
    ("a<script>b", "a"), ("a<script b", "a"), ("a<style>b</style>c", "a c"),
    ("it's <b>don't</b>", "it's don't"),
    ("&#65&#66;&#x43 &#0&#6", "ABC �\x06"),
    ("&#65&#653", "Aʍ"),
    ("&copy;&copy &amp;lt;", "©&copy &lt;"),
    ("", ""), (None, ""),
])
def test_text(spark, html, text):
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(html_to_text("h").alias("t")).first().t == text


def test_code_cut_off(spark):
    df = spark.createDataFrame([('x<pre class="k"><code a="1>2">v = 1 &lt; 2</code></pre>y<pre>z',), ("x<pre y",)], "h string")
    got = [(r.b, r.t) for r in df.select(html_code_blocks("h").alias("b"), html_without_code("h").alias("t")).collect()]
    assert got == [(["v = 1 < 2", "z"], "x [CODE] y [CODE] "), ([""], "x [CODE] ")]


@pytest.mark.parametrize("unit", ["<!--", "<script ", "<a ", "<pre ", '<a b="', "<a b='\"", "&#", "<script>", "</script ", "a=\"<b "])
def test_a_megabyte_left_open(spark, unit):
    df = spark.range(1).select(F.repeat(F.lit(unit), (1 << 20) // len(unit)).alias("h"))
    start = time.time()
    df.select(F.length(html_to_text("h")), F.size(html_code_blocks("h")), F.length(html_without_code("h"))).collect()
    assert time.time() - start < 8


def test_a_tag_with_many_attributes(spark):
    df = spark.range(1).select(F.concat(F.lit("x<p "), F.repeat(F.lit('a="1>2" '), 100_000), F.lit(">y")).alias("h"))
    assert df.select(html_to_text("h").alias("t")).first().t == "x y"
