"""Named evaluation queries: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.operators import evaluate, fusion
from quillrank.operators.bm25 import with_payload
from quillrank.operators.rerank import coverage_scores, rerank
from quillrank.operators.util import materialize
from quillrank.plans.retrieval import clean_corpus, hybrid_lists, index_with_vectors


def build_eval_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth from the cleaned corpus (score >= 50, top 100)."""
    return evaluate.build_eval_set(clean_corpus(spark, sf_dir)).drop("seq")


def _eval_lists(spark: SparkSession, sf_dir: str):
    """The three methods of the reference's evaluation for every gt item:
    BM25-10, dense-10 (both with the vote filter), and RRF(bm25, dense)[:20]
    reranked to 10.  Returns (index, gt, lists) with lists keyed by method."""
    clean = clean_corpus(spark, sf_dir)
    index = index_with_vectors(clean)
    gt = materialize(evaluate.build_eval_set(clean))      # few rows, read by several branches
    questions = gt.select(F.col("gt_rank").alias("query_id"),
                          F.col("question_title").alias("question"))
    legs = hybrid_lists(index, clean, questions, 10)
    pool = materialize(fusion.rrf(legs, top_n=20))      # small; read by several branches
    scores = coverage_scores(index, clean, pool, questions, ["query_id"])
    reranked = rerank(pool, scores, ["query_id"], top_k=10)
    lists = (legs.where(F.col("list_no") == 0).select(F.lit("bm25").alias("method"),
                                                        "query_id", "rank", "seq")
             .unionByName(legs.where(F.col("list_no") == 1).select(
                 F.lit("dense").alias("method"), "query_id", "rank", "seq"))
             .unionByName(reranked.select(F.lit("hybrid").alias("method"), "query_id",
                                          F.col("rerank_rank").alias("rank"), "seq")))
    lists = with_payload(lists, index.docs, ["question_id"])
    return index, gt, lists, pool


def retrieval_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit@5, Hit@10, MRR per method over the whole ground-truth set."""
    _, gt, lists, _ = _eval_lists(spark, sf_dir)
    gold = gt.select(F.col("gt_rank").alias("query_id"), "question_id")
    methods = gold.select("query_id", "question_id",
                          F.explode(F.array(*[F.lit(m) for m in ("bm25", "dense", "hybrid")]))
                          .alias("method"))
    per_q = evaluate.gold_hits(lists, methods, ["method", "query_id"])
    return evaluate.retrieval_summary(per_q)


def method_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per gt item and method (bm25, dense, hybrid = fused top 5,
    reranked), whether the gold doc is in the first 5 and at which rank."""
    _, gt, lists, pool = _eval_lists(spark, sf_dir)
    fused5 = pool.where(F.col("fused_rank") <= 5).select(
        F.lit("hybrid").alias("method"), "query_id", F.col("fused_rank").alias("rank"), "seq")
    all_lists = (lists.where(F.col("method") != "hybrid").drop("question_id")
                 .unionByName(fused5)
                 .unionByName(lists.where(F.col("method") == "hybrid").drop("question_id")
                              .withColumn("method", F.lit("reranked"))))
    top5 = all_lists.where(F.col("rank") <= 5)
    gold = gt.select(F.col("gt_rank").alias("query_id"), F.col("seq").alias("gold_seq"))
    grid = gold.select("query_id", "gold_seq", F.explode(F.array(
        *[F.lit(m) for m in ("bm25", "dense", "hybrid", "reranked")])).alias("method"))
    hits = (top5.join(grid, ["query_id", "method"])
            .where(F.col("seq") == F.col("gold_seq"))
            .groupBy("query_id", "method").agg(F.min("rank").alias("gold_rank")))
    return grid.join(hits, ["query_id", "method"], "left").select(
        "query_id", "method", F.col("gold_rank").isNotNull().alias("found"),
        F.col("gold_rank").alias("rank"))


def rrf_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-10 fused docs of each gt item with each list's share."""
    clean = clean_corpus(spark, sf_dir)
    index = index_with_vectors(clean)
    gt = materialize(evaluate.build_eval_set(clean))      # few rows, read by several branches
    questions = gt.select(F.col("gt_rank").alias("query_id"),
                          F.col("question_title").alias("question"))
    legs = hybrid_lists(index, clean, questions, 10)
    fused = fusion.rrf(legs, top_n=10)
    contrib = (F.lit(1.0) / (F.lit(60.0) + F.col("rank").cast("double"))).cast(fusion.RRF_DEC)
    per_list = legs.groupBy("query_id", "seq").agg(
        F.sum(F.when(F.col("list_no") == 0, contrib)).alias("bm25_part"),
        F.sum(F.when(F.col("list_no") == 1, contrib)).alias("dense_part"))
    out = with_payload(fused.join(per_list, ["query_id", "seq"], "left"), index.docs,
                       ["question_id"])
    return out.select("query_id", "fused_rank", "question_id",
                      F.round(F.col("rrf_score").cast("double"), 6).alias("rrf_score"),
                      F.round(F.coalesce("bm25_part", F.lit(0)).cast("double"), 6).alias("bm25_part"),
                      F.round(F.coalesce("dense_part", F.lit(0)).cast("double"), 6).alias("dense_part"))
