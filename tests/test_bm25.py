"""BM25 against a brute-force scorer on a ten-document corpus."""

import math

from pyspark.sql import functions as F

from quillrank.operators.bm25 import bm25_search
from quillrank.operators.index import build_index

DOCS = [
    "the cat sat on the mat", "the dog ate the cat food", "a bird in the hand",
    "the the the the", "cats and dogs living together", "exact copy here",
    "exact copy here", "rare zebra word", "the mat is red", "nothing in common at all",
]


def brute(query, docs, k1=1.5, b=0.75, eps=0.25):
    toks = [d.lower().split() for d in docs]
    n = len(toks)
    avgdl = sum(len(t) for t in toks) / n
    df = {}
    for t in toks:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: (eps * mean if v < 0 else v) for w, v in idf.items()}
    scores = []
    for t in toks:
        s = 0.0
        for q in query.lower().split():
            f = t.count(q)
            s += idf.get(q, 0) * (f * (k1 + 1) / (f + k1 * (1 - b + b * len(t) / avgdl)))
        scores.append(s)
    order = sorted(range(n), key=lambda i: -round(scores[i], 6))  # stable: ties keep position
    return [(i, round(scores[i], 6)) for i in order]


def corpus(spark):
    rows = [(i, f"t{i}", d) for i, d in enumerate(DOCS)]
    return spark.createDataFrame(rows, "seq long, question_title string, answer_prose string") \
        .withColumn("question_title", F.lit(""))


def test_bm25_matches_brute_force(spark):
    index = build_index(corpus(spark))
    queries = ["the cat", "zebra", "unknownterm", "cat cat mat", "exact copy"]
    qdf = spark.createDataFrame(list(enumerate(queries)), "query_id long, question string")
    got = bm25_search(index, qdf, top_k=4).orderBy("query_id", "rank").collect()
    by_q = {}
    for r in got:
        by_q.setdefault(r.query_id, []).append((r.seq, round(r.score, 6)))
    for qi, q in enumerate(queries):
        want = brute(q, [" " + d for d in DOCS])[:4]
        assert by_q[qi] == want, (q, by_q[qi], want)


def test_zero_fill_uses_corpus_order(spark):
    index = build_index(corpus(spark))
    qdf = spark.createDataFrame([(0, "zebra")], "query_id long, question string")
    got = [r.seq for r in bm25_search(index, qdf, top_k=3).orderBy("rank").collect()]
    assert got == [7, 0, 1]


def test_filter_keeps_global_statistics(spark):
    docs = corpus(spark).withColumn("question_score", F.col("seq").cast("int"))
    index = build_index(docs)
    qdf = spark.createDataFrame([(0, "the cat")], "query_id long, question string")
    full = {r.seq: r.score for r in bm25_search(index, qdf, top_k=10).collect()}
    filt = bm25_search(index, qdf, top_k=3, min_score=2).orderBy("rank").collect()
    assert all(r.seq >= 2 for r in filt)
    assert all(abs(full[r.seq] - r.score) < 1e-9 for r in filt)


def test_zero_fill_with_negative_scores(spark):
    # Five documents share every term of "a b c d e"; the mean idf is negative,
    # so matches score below 0 and the unmatched document must rank first.
    docs = ["a b c d e"] * 5 + ["z"]
    rows = [(i, "", d) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "seq long, question_title string, answer_prose string")
    index = build_index(df)
    qdf = spark.createDataFrame([(0, "a")], "query_id long, question string")
    got = [(r.seq, round(r.score, 6)) for r in bm25_search(index, qdf, top_k=3).orderBy("rank").collect()]
    want = brute("a", [" " + d for d in docs])[:3]
    assert got == want and got[0][0] == 5
