"""No caps: long inputs and large values come through whole."""

import numpy as np
from pyspark.sql import functions as F

from quillrank.functions.html import html_code_blocks, html_to_text, html_without_code
from quillrank.functions.text import safe_int
from quillrank.operators import dense, fusion
from quillrank.operators.pairs import export_rows
from quillrank.plans.retrieval import clean_corpus
from quillrank.streaming.logs_stream import stream_query_volume


def _one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("x")).first()["x"]


def test_all_named_and_long_numeric_references(spark):
    assert _one(spark, "caf&eacute; &frac12; &alpha; &#00000000065; &#x0000041; &amp;lt; &nosuch;", html_to_text) \
        == "café ½ α A A &lt; &nosuch;"


def test_safe_int_is_wide(spark):
    assert _one(spark, "3000000000", safe_int) == 3_000_000_000
    assert _one(spark, "-1e300", safe_int) == 0


def test_export_has_no_default_cut(spark):
    rows = [(str(i), "1" if i % 2 else "2", str(i + 1), "9", "<python>", "2021-01-01", None, "t", "b", i) for i in range(1, 5)]
    posts = spark.createDataFrame(rows, "Id string, PostTypeId string, AcceptedAnswerId string, Score string, Tags string, "
                                        "CreationDate string, ClosedDate string, Title string, Body string, seq long")
    assert export_rows(posts).count() == 3
    assert export_rows(posts, 1).count() == 1


def test_rrf_fuses_on_the_document(spark):
    rows = [(1, 0, 1, 5, "x"), (1, 0, 2, 10, "d"), (1, 0, 3, 20, "d")]
    got = fusion.rrf(spark.createDataFrame(rows, "query_id long, list_no int, rank int, seq long, doc_id string")).orderBy("fused_rank").collect()
    assert [(r.doc_id, r.seq) for r in got] == [("d", 10), ("x", 5)]


def test_streams_read_folders_of_part_files(spark, tmp_path):
    from conftest import SMALL
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    got, want = (stream_query_volume(spark, d).select(F.sum("queries")).first()[0] for d in (str(tmp_path), SMALL))
    assert got == want


def test_unclosed_pre_ends_with_the_text(spark):
    html = "<p>a</p><pre><code>x = 1</code></pre><p>b</p><pre>y = <b>2</b>\nz"
    assert _one(spark, html, html_code_blocks) == ["x = 1", "y = 2\nz"]
    assert _one(spark, html, html_without_code) == "<p>a</p> [CODE] <p>b</p> [CODE] "


def test_dense_ties_never_exceed_k_rows_a_task(spark):
    docs = spark.range(4096).select(F.col("id").alias("seq"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding")).coalesce(1)
    queries = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "query_id long, embedding array<double>")
    cos = dense._cosines(np.tile([1.0, 0.0], (4096, 1)), np.array([[0.0, 0.0], [1.0, 0.0]]))
    at, of = dense._best(cos, np.arange(4096), 10)
    assert at.tolist() == 2 * list(range(10)) and of.tolist() == 10 * [0] + 10 * [1]
    got = dense.dense_search(docs.repartition(3), queries, 10).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.seq) for r in got] == [(q, i) for q in (1, 2) for i in range(10)]


def test_replaced_files_give_new_answers(spark, tmp_path):
    from conftest import SMALL
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs.where("doc_id % 2 = 0").write.parquet(str(tmp_path / "documents.parquet"))
    before = clean_corpus(spark, str(tmp_path)).count()
    docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    after = clean_corpus(spark, str(tmp_path)).count()
    assert before < after == clean_corpus(spark, SMALL).count()
