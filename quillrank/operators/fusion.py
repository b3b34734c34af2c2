"""Reciprocal Rank Fusion and list plumbing.

Lists are rows ``(key..., list_no, rank, seq)``; fusion is one aggregation by
(key, seq).  Each contribution 1/(k + rank) is summed as a DECIMAL so the
fused score is exact and order-free; equal fused scores keep the reference's
first-seen order: the first list a document appears in, then its rank there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the RRF constant.
RRF_K = 60
RRF_DEC = "decimal(28,15)"


def tag_list(ranked: DataFrame, list_no) -> DataFrame:
    """Give a ranked list its list number (a column or a constant)."""
    ln = list_no if not isinstance(list_no, int) else F.lit(list_no)
    return ranked.withColumn("list_no", ln.cast("int"))


def rrf(lists: DataFrame, key_cols: list[str] | None = None, k: int = RRF_K,
        top_n: int | None = None) -> DataFrame:
    """(key..., seq, rrf_score DECIMAL, first_list, first_rank, fused_rank).

    Lists with a ``doc_id`` fuse on it: a document held under several positions is
    one row, at the position of its first mention.
    """
    ident = "doc_id" if "doc_id" in lists.columns else "seq"
    key_cols = key_cols or ["query_id"]
    contrib = (F.lit(1.0) / (F.lit(float(k)) + F.col("rank").cast("double"))).cast(RRF_DEC)
    fused = lists.groupBy(*key_cols, ident).agg(
        F.sum(contrib).alias("rrf_score"),
        F.min(F.struct("list_no", "rank", "seq")).alias("first"))
    fused = fused.select(*key_cols, *([ident] if ident != "seq" else []), F.col("first.seq").alias("seq"), "rrf_score",
                         F.col("first.list_no").alias("first_list"),
                         F.col("first.rank").alias("first_rank"))
    w = Window.partitionBy(*key_cols).orderBy(F.col("rrf_score").desc(), "first_list",
                                              "first_rank")
    out = fused.withColumn("fused_rank", F.row_number().over(w))
    return out.where(F.col("fused_rank") <= top_n) if top_n else out
