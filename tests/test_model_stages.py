"""Chat calls in flight, answering by a client, failing searches, and a request batch with user models."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from quillrank.operators import logs, models
from quillrank.operators.generate import ANSWER_SYSTEM, answer_with_client
from quillrank.operators.index import build_index
from quillrank.operators.models import CallOptions, ModelCallError, Models, Pace, batch_complete
from quillrank.operators.util import isolated
from quillrank.plans import pipeline


class CountingClient:
    """Reports, in every answer, the most calls that were under way at once."""

    def __init__(self):
        self.lock, self.now, self.most = threading.Lock(), 0, 0

    def complete(self, prompt, system=None, temperature=None, max_tokens=None):
        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)
        time.sleep(0.01)
        with self.lock:
            self.now -= 1
        return f"{prompt}|{self.most}|{system}|{temperature}|{max_tokens}"


def test_calls_in_flight_are_bounded_and_in_order(spark):
    df = spark.range(40).select("id", F.concat(F.lit("p"), "id").alias("prompt")).coalesce(1)
    opts = CallOptions(system="be brief", temperature=0.0)
    got = batch_complete(df, "prompt", CountingClient, ["id"], options=opts, in_flight=4).collect()
    parts = [r.completion.split("|") for r in got]
    assert [r.id for r in got] == list(range(40)) and [p[0] for p in parts] == [f"p{i}" for i in range(40)]
    assert 1 < max(int(p[1]) for p in parts) <= 4
    assert {tuple(p[2:]) for p in parts} == {("be brief", "0.0", "None")}
    alone = batch_complete(df, "prompt", CountingClient, ["id"]).collect()
    assert {r.completion.split("|")[1] for r in alone} == {"1"}


def test_back_off_is_shared():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pace = Pace(lambda: now[0], sleep)
    pace.hold(4.0)
    pace.hold(1.0)  # a shorter one does not cut the longer
    assert models.call_with_retry(lambda: "ok", pace=pace) == ("ok", None, 1)
    assert slept == [4.0] and now[0] == 4.0
    calls = []

    def down():
        calls.append(now[0])
        raise ModelCallError("HTTP 503", status=503)

    assert models.call_with_retry(down, base_wait=2.0, pace=pace)[2] == 3
    assert calls == [4.0, 6.0, 10.0]


class Answerer:
    def complete(self, prompt, system=None, temperature=None, max_tokens=None):
        assert system == ANSWER_SYSTEM and (temperature, max_tokens) == (0.2, 1024)
        if "boom" in prompt:
            raise ModelCallError("HTTP 400", status=400)
        return "answer to " + prompt.split("\n")[0]


def test_answer_with_client(spark):
    q = spark.createDataFrame([(1, "how"), (2, "boom"), (3, "none"), (4, None)], "query_id long, question string")
    ctx = spark.createDataFrame([(1, 1, "c"), (2, 1, "c"), (4, 1, None)], "query_id long, n_sources int, context string")
    got = {r.query_id: r.answer for r in answer_with_client(q, ctx, Answerer, ["query_id"]).collect()}
    assert got == {1: "answer to Question: how", 2: "Answer generation failed: HTTP 400",
                   3: models.NO_SOURCES_ANSWER, 4: "answer to Question: "}


def test_isolated_keeps_rows_or_the_error(spark):
    rows, error = isolated("fine", lambda: spark.range(3), "id long")
    assert rows.count() == 3 and error is None
    rows, error = isolated("run time", lambda: spark.range(3).select(F.raise_error(F.lit("leg down")).cast("long").alias("id")), "id long")
    assert rows.count() == 0 and "leg down" in error
    rows, error = isolated("plan time", lambda: spark.range(3).select("nothing"), "id long")
    assert rows.count() == 0 and "nothing" in error
    with pytest.raises(ZeroDivisionError):  # faults of the caller's own code are no search errors
        isolated("code", lambda: 1 / 0, "id long")


class Rewriter:
    def complete(self, prompt):
        q = prompt.split("Question: ")[1].split("\n")[0]
        return f'["{q}", "sort a list"]'


class Judge:
    def complete(self, prompt, temperature=None, max_tokens=None):
        return '{"relevance": 3, "accuracy": 2, "completeness": 1, "reasoning": "seen"}'


class Embedder:
    def encode(self, texts):
        import numpy as np
        return np.array([[t.count("sort") + 0.1, t.count("async") + 0.1, 1.0] for t in texts])


class NoEmbedder:
    def encode(self, texts):
        raise RuntimeError("no weights")


class Scorer:
    def predict(self, pairs):
        return [float(text.count("sort")) for _, text in pairs]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, f"d{i}", f"q{i}", f"title {i} " + ("sort" if i % 2 else "async"),
             ("sort list " if i % 2 else "async io ") * (1 + i % 3) + f"w{i}", ["x"], f"u{i}",
             ["en"] if i < 20 else ["de"], i, f"2020-01-{1 + i % 28:02d}") for i in range(30)]
    clean = spark.createDataFrame(rows, "seq long, doc_id string, question_id string, question_title string, "
                                  "answer_prose string, answer_code_blocks array<string>, question_url string, "
                                  "tags_list array<string>, question_score int, creation_date string")
    return clean, build_index(clean)


REQUEST = "query_id long, question string, min_vote_score int, tags array<string>, after_date string, top_k int"


def test_request_batch_with_user_models(spark, corpus):
    clean, index = corpus
    req = spark.createDataFrame([(1, "how to sort a list", 10, ["en"], None, 3),
                                 (2, "async io question", None, None, None, None),
                                 (3, "bad top k", None, None, None, 900)], REQUEST)
    m = Models(Rewriter, Embedder, Scorer, Answerer, Judge, in_flight=2)
    answers, sources, rejects, errors = pipeline.answer_requests(clean, index, req, m)
    assert errors == {} and [r.query_id for r in rejects.collect()] == [3]
    rows = {r.query_id: r for r in answers.collect()}
    assert rows[1].rewritten_queries == ["how to sort a list", "sort a list"]
    assert rows[1].answer == "answer to Question: how to sort a list" and tuple(rows[1].judge) == (3, 2, 1, "seen")
    mine = sources.where("query_id = 1").collect()
    assert len(mine) == 3 and all(r.question_score >= 10 and r.tags_list == ["en"] for r in mine)
    assert sources.where("query_id = 2").count() == 5  # the default number of sources
    log = {r.question: r for r in logs.log_rows(answers).collect()}
    assert log["how to sort a list"].judge_relevance == 3 and log["how to sort a list"].total_ms is None
    assert len({r.session_id for r in log.values()}) == 2


def test_a_failing_search_leaves_the_other(spark, corpus, monkeypatch):
    clean, index = corpus
    req = spark.createDataFrame([(1, "how to sort a list", 1, None, None, 3)], REQUEST)

    def down(*_, **__):
        return spark.range(1).select(F.raise_error(F.lit("store down")).cast("int").alias("rank"))

    with monkeypatch.context() as mp:
        mp.setattr("quillrank.plans.retrieval.dense.dense_search", down)
        answers, sources, _, errors = pipeline.answer_requests(clean, index, req)
        assert list(errors) == ["dense"] and sources.count() == 3
    with pytest.raises(Exception, match="no weights"):  # embedding is not part of a search
        pipeline.answer_requests(clean, index, req, Models(embedder=NoEmbedder))
