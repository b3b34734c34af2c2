"""Client-backed model stages, streaming = batch, source/sink round trips."""

from pyspark.sql import functions as F

from conftest import SMALL
from quillrank.operators.generate import judge_with_client, rewrite_with_client
from quillrank.operators.models import ModelCallError
from quillrank.plans import analytics, ingest
from quillrank.streaming import logs_stream


class EchoJsonClient:
    def complete(self, prompt):
        if "boom" in prompt:
            raise ModelCallError("HTTP 400", status=400)
        if "Rewrite the developer question" in prompt:
            return '```json\n["first part", "  second part "]\n```'
        return '{"relevance": 4, "accuracy": 9, "completeness": 2.9, "reasoning": "fine"}'


def test_rewrite_and_judge_with_client(spark):
    q = spark.createDataFrame([(1, "how to sort"), (2, "boom question")],
                              "query_id long, question string")
    rw = {r.query_id: r.rewritten_queries
          for r in rewrite_with_client(q, EchoJsonClient, ["query_id"]).collect()}
    assert rw == {1: ["first part", "second part"], 2: ["boom question"]}
    a = q.withColumn("answer", F.lit("some answer"))
    js = {r.query_id: tuple(r.judge) for r in judge_with_client(a, EchoJsonClient, ["query_id"]).collect()}
    assert js[1] == (4, 5, 2, "fine")
    assert js[2] == (None, None, None, "judge error")


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_streams_equal_batch(spark):
    assert _rows(logs_stream.stream_query_volume(spark, SMALL)) == \
        _rows(analytics.query_volume_hourly(spark, SMALL))
    assert _rows(logs_stream.stream_feedback(spark, SMALL)) == \
        _rows(analytics.feedback_latest(spark, SMALL))


def test_roundtrips_equal_direct(spark):
    assert _rows(ingest.csv_roundtrip(spark, SMALL)) == _rows(ingest.posts_self_join_top(spark, SMALL))
    assert _rows(ingest.xml_roundtrip(spark, SMALL)) == _rows(ingest.qa_pairs_join(spark, SMALL))


class TinyEmbedder:
    def encode(self, texts):
        import numpy as np
        return np.array([[len(t), t.count("a"), 0.0] for t in texts], dtype=float)


class LengthScorer:
    def predict(self, pairs):
        if any("explode" in t for _, t in pairs):
            raise RuntimeError("scorer down")
        return [float(len(t)) for _, t in pairs]


def test_embed_and_score_jobs(spark):
    from quillrank.operators.models import embed_job, pair_scorer_job
    df = spark.createDataFrame([(1, "banana"), (2, "")], "k long, text string")
    got = {r.k: list(r.embedding) for r in embed_job(df, ["k"], "text", TinyEmbedder).collect()}
    assert abs(sum(x * x for x in got[1]) - 1.0) < 1e-6 and got[2] == [0.0, 0.0, 0.0]
    pairs = spark.createDataFrame([(1, 10, "q", "abc"), (1, 11, "q", "abcdef")],
                                  "query_id long, seq long, question string, text string")
    sc = {r.seq: r.reranker_score
          for r in pair_scorer_job(pairs, ["query_id", "seq"], "question", "text", LengthScorer).collect()}
    assert sc == {10: 3.0, 11: 6.0}
    bad = pairs.withColumn("text", F.lit("explode"))
    sc = {r.seq: r.reranker_score
          for r in pair_scorer_job(bad, ["query_id", "seq"], "question", "text", LengthScorer).collect()}
    assert sc == {10: 0.0, 11: 0.0}
