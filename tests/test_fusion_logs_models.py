"""RRF tie rules, log metrics edge cases, retrying model calls."""

import datetime as dt

from pyspark.sql import functions as F

from quillrank.operators import fusion, logs
from quillrank.operators.models import ModelCallError, ScriptedClient, call_with_retry


def test_rrf_ties_keep_first_seen_order(spark):
    # doc 10 first in list 0, doc 20 first in list 1: equal fused scores,
    # list 0 wins; doc 30 twice in one list adds both contributions.
    rows = [(1, 0, 1, 10), (1, 1, 1, 20), (1, 0, 2, 30), (1, 0, 3, 30)]
    lists = spark.createDataFrame(rows, "query_id long, list_no int, rank int, seq long")
    got = fusion.rrf(lists).orderBy("fused_rank").collect()
    assert [r.seq for r in got] == [30, 10, 20]
    assert abs(float(got[0].rrf_score) - (1 / 62 + 1 / 63)) < 1e-12


def test_rrf_empty_list(spark):
    lists = spark.createDataFrame([], "query_id long, list_no int, rank int, seq long")
    assert fusion.rrf(lists).count() == 0


def _log(spark, rows):
    return spark.createDataFrame(rows, "id long, session_id string, timestamp timestamp, "
                                       "judge_relevance int, total_ms int")


def _fb(spark, rows):
    return spark.createDataFrame(rows, "session_id string, ts timestamp, seq long, feedback int")


def test_feedback_update_semantics(spark):
    t = dt.datetime(2024, 1, 1)
    lg = _log(spark, [(1, "s1", t, 5, 10), (2, "s1", t + dt.timedelta(hours=2), 4, 20),
                      (3, "s2", t, 3, 30)])
    fb = _fb(spark, [("s1", t + dt.timedelta(hours=1), 1, 1), ("s1", t + dt.timedelta(hours=1), 2, 0),
                     ("zz", t, 3, 1)])
    out = {r.id: r.user_feedback for r in logs.with_feedback(lg, fb).collect()}
    # row 2 was logged after the last feedback of its session; unknown session ignored
    assert out == {1: 0, 2: None, 3: None}


def _with_cols(df):
    return df.withColumn("user_feedback", F.lit(None).cast("int")) \
        .withColumn("judge_accuracy", F.lit(1)).withColumn("judge_completeness", F.lit(1))


def test_metrics_empty_and_unrated(spark):
    empty = _with_cols(_log(spark, []))
    m = logs.metrics(empty).collect()[0]
    assert m.total_queries == 0 and m.feedback_pct is None       # empty log -> null
    unrated = _with_cols(_log(spark, [(1, "s", dt.datetime(2024, 1, 1), 5, 10)]))
    assert logs.metrics(unrated).collect()[0].feedback_pct == 0.0  # no feedback -> 0.0
    assert logs.feedback_pct(unrated).collect()[0].pct is None     # NULLIF form -> null


def test_retry_policy():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 2:
            raise ModelCallError("HTTP 503", status=503)
        return "ok"
    assert call_with_retry(flaky, base_wait=0, sleep=lambda s: None) == ("ok", None, 2)

    def unauthorized():
        raise ModelCallError("HTTP 401", status=401)
    assert call_with_retry(unauthorized, sleep=lambda s: None)[1:] == ("HTTP 401", 1)

    waits = []

    def down():
        raise ModelCallError("HTTP 503", status=503)
    text, err, n = call_with_retry(down, base_wait=2.0, sleep=waits.append)
    assert text is None and n == 3 and waits == [2.0, 4.0]  # no wait after the last try


def test_scripted_client_is_deterministic():
    a, b = ScriptedClient(), ScriptedClient()
    outs = []
    for c in (a, b):
        res = []
        for p in ["alpha beta", "gamma", "delta epsilon zeta"]:
            res.append(call_with_retry(lambda p=p, c=c: c.complete(p), base_wait=0,
                                       sleep=lambda s: None))
        outs.append(res)
    assert outs[0] == outs[1]
