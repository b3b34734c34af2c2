"""Evaluation.

The reference loops over questions; here the whole ground-truth set is one
query batch, and metrics are a join of ranked lists to gold ids followed by
one aggregation per method.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Evaluation defaults.
GT_MIN_SCORE = 50
GT_SIZE = 100


def build_eval_set(clean: DataFrame, min_score: int = GT_MIN_SCORE, n: int = GT_SIZE) -> DataFrame:
    """The n highest-scored pairs (score >= min_score), ties in
    corpus order, with ``gt_rank`` (file order of the reference's JSONL).

    The cut is a distributed top-n (each task keeps n rows); numbering the n
    survivors is a window over at most n rows."""
    order = [F.col("question_score").desc(), F.col("seq").asc()]
    top = (clean.where(F.coalesce("question_score", F.lit(0)) >= min_score)
           .orderBy(*order).limit(n))
    return top.select(
        F.row_number().over(Window.orderBy(*order)).alias("gt_rank"),
        "question_id", "question_title",
        F.col("question_prose").alias("question_body"), "question_url",
        F.col("answer_prose").alias("accepted_answer"), "tags_list", "question_score", "seq")


def gold_hits(ranked: DataFrame, gold: DataFrame, key_cols: list[str],
              rank_col: str = "rank") -> DataFrame:
    """Per query, first rank of the gold id (lists cut at 10):
    (key..., hit5, hit10, rr).  Missing gold -> 0, 0, 0."""
    found = (ranked.join(gold, key_cols + ["question_id"], "inner")
             .groupBy(*key_cols).agg(F.min(rank_col).alias("gold_rank")))
    per_q = gold.select(*key_cols).join(found, key_cols, "left")
    r = F.col("gold_rank")
    return per_q.select(
        *key_cols,
        F.when(r <= 5, 1).otherwise(0).alias("hit5"),
        F.when(r <= 10, 1).otherwise(0).alias("hit10"),
        F.when(r.isNotNull(), F.lit(1.0) / r.cast("double")).otherwise(F.lit(0.0)).alias("rr"))


def retrieval_summary(per_question: DataFrame) -> DataFrame:
    """Per method mean hit@5, hit@10, MRR (4 places) and n."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return per_question.groupBy("method").agg(
        F.round(F.sum("hit5") / n, 4).alias("hit_rate_at_5"),
        F.round(F.sum("hit10") / n, 4).alias("hit_rate_at_10"),
        F.round(F.sum("rr") / n, 4).alias("mrr"),
        n.alias("n_questions"))


def generation_summary(results: DataFrame) -> DataFrame:
    """Mean of each judge score over rows that have it, mean latency over
    non-zero latencies, n = every attempted question (failures included)."""
    def avg(c):
        return F.round(F.avg(c), 4)
    return results.agg(
        avg(F.col("judge.relevance").cast("double")).alias("avg_relevance"),
        avg(F.col("judge.accuracy").cast("double")).alias("avg_accuracy"),
        avg(F.col("judge.completeness").cast("double")).alias("avg_completeness"),
        avg(F.when(F.col("total_ms") != 0, F.col("total_ms").cast("double"))).alias("avg_latency_ms"),
        F.count(F.lit(1)).alias("n_questions"))


def ragas_summary(scores: DataFrame) -> DataFrame:
    """Four means (4 places) and n over per-row scores."""
    return scores.agg(*[F.round(F.avg(c), 4).alias(c) for c in
                        ("faithfulness", "answer_relevancy", "context_precision",
                         "context_recall")], F.count(F.lit(1)).alias("n_questions"))
