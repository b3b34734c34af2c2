"""Documents are counted and scored where they lie: no token, posting or (query, document) row is shuffled."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from quillrank.operators import bm25, dense
from quillrank.operators.index import build_index
from quillrank.operators.requests import bm25_requests
from quillrank.plans import pipeline, retrieval
from quillrank.sources import tables

CLEAN = "seq long, question_title string, answer_prose string, question_score int, tags_list array<string>, creation_date string"


def _corpus(spark, n=200):
    words = [f"w{i}" for i in range(17)]
    return spark.createDataFrame([(i, " Title", " ".join(words[i * j * j % 17] for j in range(i % 9)), i % 30,
                                   ["a"] if i % 2 else ["b"], f"2021-0{1 + i % 9}-01") for i in range(n)], CLEAN)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_embedding_and_index_shuffle_no_token(spark):
    vectors = retrieval.corpus_vectors(_corpus(spark))
    assert "Exchange" not in _plan(vectors)
    index = build_index(_corpus(spark))
    assert index.doc_terms.count() == 200
    assert "Exchange" not in _plan(index.postings)


@pytest.mark.parametrize("cells, postings, bound", [(4, 8, 64 << 20), (64, 16, 0), (1 << 21, 1 << 18, 64 << 20)])
def test_blocks_give_the_same_lists(spark, monkeypatch, cells, postings, bound):
    """One block of each side, and many that meet in a broadcast or a shuffle; a step of one posting; own filters."""
    index = build_index(_corpus(spark).repartition(3))
    ask = spark.createDataFrame([(i, f"w{i % 17} title w{i * 3 % 17} w{i * 3 % 17}", i % 25, ["a"] if i % 3 else [], "2021-04-01")
                                 for i in range(40)] + [(40, None, 0, [], None), (None, "w3", 0, [], None)],
                                "query_id long, question string, min_vote_score int, tags array<string>, after_date string")

    def lists():
        return [sorted(map(tuple, bm25.bm25_search(index, ask, 7).select("query_id", "rank", "seq", "score_micro").collect()),
                       key=str), sorted(map(tuple, bm25_requests(index, ask, 7).select("query_id", "rank", "seq", "score_micro").collect()), key=str)]

    want = lists()
    for name, value in (("QUERY_CELLS", cells), ("BLOCK_POSTINGS", postings), ("STEP_CELLS", cells), ("BROADCAST_MAX_BYTES", bound)):
        monkeypatch.setattr(bm25, name, value)
    assert lists() == want and len(want[0]) == 7 * 42


def test_matches_are_cut_in_their_block(spark):
    """Of 200 documents that share a term, a task passes on a query's k best, not a row a document."""
    index = build_index(_corpus(spark).coalesce(1))
    ask = spark.createDataFrame([(1, "title"), (2, "w1 title")], "query_id long, question string")
    assert bm25.match_scores(index, ask, ["query_id"], "question", 5).count() == 10


def test_repeated_and_null_positions(spark):
    rows = [(1, None, "a b a", 1, None, None), (1, None, "a b a", 1, None, None), (1, None, "b c d e", 2, None, None),
            (None, None, "a", 3, None, None), (None, None, "c", 3, None, None), (4, None, "", 4, None, None)]
    index = build_index(spark.createDataFrame(rows, CLEAN))
    got = sorted(map(tuple, index.postings.select("seq", "term", "tf", "dl").collect()), key=str)
    assert got == sorted([(1, "a", 4, 3), (1, "b", 2, 3), (1, "b", 1, 4), (1, "c", 1, 4), (1, "d", 1, 4), (1, "e", 1, 4),
                          (None, "a", 1, 1), (None, "c", 1, 1)], key=str)
    assert {r.term: r.n_t for r in index.term_stats.collect()} == {"a": 2, "b": 2, "c": 2, "d": 1, "e": 1}
    vectors = dense.hash_embed(spark.createDataFrame(rows, CLEAN), ["seq"], "answer_prose")
    assert {r.seq: sum(r.embedding.val) for r in vectors.collect()} == {1: 10.0, None: 2.0}


def test_ties_across_blocks_of_a_task(spark):
    docs = spark.range(300).select((299 - F.col("id")).alias("seq"), F.array(F.lit(1.0), F.col("id") % 3 / 1e9).alias("embedding")).coalesce(1)
    ask = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    got = dense.dense_search(docs, ask, 4, block_cells=20).orderBy("rank").collect()
    assert [r.seq for r in got] == [0, 1, 2, 3]


def test_corpus_is_cleaned_once(spark, monkeypatch):
    real, calls = pipeline.clean_corpus, []
    monkeypatch.setattr(pipeline, "clean_corpus", lambda *a: calls.append(a) or real(*a))
    assert pipeline.generation_eval(spark, SMALL).first()["n_questions"] > 0
    pipeline.ragas_eval(spark, SMALL).first()
    assert len(calls) == 2


def test_workers_take_small_batches(spark):
    text = spark.range(4).select(F.repeat(F.lit("x"), 3 << 20).alias("t")).coalesce(1)
    sizes = text.mapInArrow(lambda bs: (b.select([]).from_arrays([[b.num_rows]], ["n"]) for b in bs), "n long").collect()
    assert max(r.n for r in sizes) <= 2


def test_titles_are_the_first_eight_tokens(spark):
    texts = ["a b c d e f g h i j", "  a\tb  c d e f g h ", "a", " ", None, " a b c d e f g h i"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(tables._first8(F.col("t")).alias("x"))
    assert [r.x for r in frame.collect()] == ["a b c d e f g h", "a b c d e f g h", "a", "", None, "a b c d e f g h"]
