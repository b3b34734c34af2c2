"""Reranking.

The default pair scorer is idf-weighted query-term coverage: the share of the
question's distinct terms (weighted by corpus idf) that occur in the
candidate's ``title + answer`` text.  Each candidate is joined to its own text
and scored in its row: no postings are read and nothing is shuffled by term.  A
user scorer (a cross-encoder) plugs in through ``models.pair_scorer_job``, whose
scores feed the same ``rerank`` cut (cast them to the score type first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.core import let
from quillrank.functions.text import bm25_tokens, pair_text
from quillrank.operators.bm25 import query_terms
from quillrank.operators.index import EPSILON, Bm25Index
from quillrank.operators.util import fits_broadcast

SCORE_OUT = "decimal(18,6)"
_SUM = "decimal(38,12)"


def coverage_scores(index: Bm25Index, clean: DataFrame, candidates: DataFrame, questions: DataFrame,
                    key_cols: list[str], text_col: str = "question") -> DataFrame:
    """M2 default: (key..., seq, reranker_score DECIMAL(18,6)) for each candidate;
    ``clean`` holds the candidates' ``question_title`` and ``answer_prose``."""
    qt = query_terms(questions, key_cols, text_col).select(*key_cols, "term")
    idf = (index.term_stats.crossJoin(F.broadcast(index.corpus_stats.select("mean_idf")))
           .select("term", F.when(F.col("raw_idf") < 0, F.lit(EPSILON) * F.col("mean_idf"))
                   .otherwise(F.col("raw_idf")).cast("decimal(28,12)").alias("idf")))
    # Unknown terms weigh 0, as in BM25; they are in no text either.
    # One measurement of the query side bounds both broadcasts (the weights are its rows, a number wider).
    small = fits_broadcast(qt)
    weights = idf.join(F.broadcast(qt) if small else qt, "term").groupBy(*key_cols).agg(
        F.collect_list(F.struct("term", "idf")).alias("weights"), F.sum("idf").alias("total"))
    pairs = candidates.select(*key_cols, "seq").distinct()
    # Texts stay where they lie: the pairs, a few numbers each, go to them, then the question's weights.
    texts = (clean.select("seq", "question_title", "answer_prose").join(pairs, "seq")
             .join(F.broadcast(weights) if small else weights, key_cols, "left"))
    text = pair_text(F.col("question_title"), F.col("answer_prose"))
    # One hash lookup a token finds the terms that the text holds; their weights are summed after it.
    held = F.array_intersect(F.col("weights")["term"], bm25_tokens(text))
    hit = let(held, lambda terms: F.aggregate(
        F.filter("weights", lambda w: F.array_contains(terms, w["term"])), F.lit(0).cast(_SUM),
        lambda acc, w: (acc + w["idf"]).cast(_SUM)))
    score = F.when(F.col("total") > 0, hit.cast("double") / F.col("total").cast("double")).otherwise(F.lit(0.0))
    return texts.select(*key_cols, "seq", score.cast(SCORE_OUT).alias("reranker_score"))


def rerank(candidates: DataFrame, scores: DataFrame, key_cols: list[str], top_k: int = 5,
           order_col: str = "fused_rank") -> DataFrame:
    """Order by reranker score, ties keep the incoming order; cut at k.
    Candidates without a score (scorer failure) get 0.0, as the reference does."""
    joined = candidates.join(scores, key_cols + ["seq"], "left").withColumn(
        "reranker_score", F.coalesce("reranker_score", F.lit(0).cast(SCORE_OUT)))
    w = Window.partitionBy(*key_cols).orderBy(F.col("reranker_score").desc(), F.col(order_col))
    return joined.withColumn("rerank_rank", F.row_number().over(w)).where(
        F.col("rerank_rank") <= top_k)
