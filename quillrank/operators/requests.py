"""Requests with parameters of their own.

A request frame holds ``query_id, question, min_vote_score, tags, after_date, top_k``.
Its rows are validated first; the broken ones go to a reject frame with
their errors.  One batch then serves any mix of filters: scored pairs meet the
documents' attributes by position and the request's parameters by key, and the
filter is a predicate over both, before the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.operators.bm25 import _negative_allowance, match_scores
from quillrank.operators.dense import DOC_FILTERS, QUERY_FILTERS
from quillrank.operators.index import Bm25Index
from quillrank.operators.validate import request_errors

# What a request that leaves a parameter out gets.
DEFAULT_MIN_SCORE, DEFAULT_TOP_K = 5, 5


def with_defaults(requests: DataFrame) -> DataFrame:
    """Missing parameters filled in: no tag or date bound, the default score bound and number of sources."""
    return requests.withColumns({
        "min_vote_score": F.coalesce("min_vote_score", F.lit(DEFAULT_MIN_SCORE)),
        "tags": F.coalesce("tags", F.array().cast("array<string>")),
        "top_k": F.coalesce("top_k", F.lit(DEFAULT_TOP_K))})


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid requests with defaults, rejects with the list of broken rules); every row is in one of them."""
    checked = request_errors(with_defaults(requests))
    return checked.where("valid").drop("valid", "errors"), checked.where(~F.col("valid")).drop("valid")


def lets_through() -> Column:
    """The filter over a document's attributes and a request's parameters."""
    tags = F.coalesce("tags_list", F.array().cast("array<string>"))
    return ((F.coalesce("question_score", F.lit(0)) >= F.col("min_vote_score"))
            & ((F.size("tags") == 0) | F.arrays_overlap(tags, F.col("tags")))
            & (F.col("after_date").isNull() | (F.coalesce("creation_date", F.lit("")) >= F.col("after_date"))))


def bm25_requests(index: Bm25Index, requests: DataFrame, top_k: int, key_cols: list[str] | None = None) -> DataFrame:
    """R2 with each request's own filter: (key..., rank, seq, score_micro, score).

    Each filter holds before the cut.  Only requests that are then short of ``top_k``
    documents are completed with unmatched ones in corpus order (score 0): these few filters are held
    against all documents, and a task keeps ``top_k`` of each.
    """
    key = key_cols or ["query_id"]
    params = requests.select(*key, *QUERY_FILTERS)
    docs = index.scored.where(F.col("seq").isNotNull())
    parts = match_scores(index, requests, key, "question", top_k, docs, QUERY_FILTERS)
    sums = parts.groupBy(*key, "seq").agg(F.sum("c").alias("nano"))
    scores = (sums.join(index.docs.select("seq", *DOC_FILTERS), "seq").join(params, key)
              .where(lets_through()).select(*key, "seq", "nano"))
    width = top_k + _negative_allowance(index, parts, key)
    # a score that rounds to 0 or less does not outrank unmatched documents, so it does not count here
    matched = scores.where("nano >= 500").groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    short = params.join(matched, key, "left").where(F.coalesce("n", F.lit(0)) < top_k).drop("n")
    first = Window.partitionBy(*key).orderBy("seq")
    fill = (index.docs.select("seq", *DOC_FILTERS).join(short, lets_through())
            .select(*key, "seq").withColumn("place", F.row_number().over(first)).where(F.col("place") <= width)
            .select(*key, "seq", F.lit(0).cast("bigint").alias("nano")))
    scores = scores.unionByName(fill).groupBy(*key, "seq").agg(F.sum("nano").alias("nano"))
    micro = F.floor((F.col("nano") + F.lit(500)) / F.lit(1000))
    w = Window.partitionBy(*key).orderBy(F.col("score_micro").desc(), F.col("seq").asc())
    return (scores.select(*key, "seq", micro.alias("score_micro"), (micro / F.lit(1e6)).alias("score"))
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k))
