"""Question/answer pair building.

Both reference paths become one join of questions to their accepted answers:

* ``pairs_from_posts`` -- the XML path: posts split by type, the last record
  per (type, Id) kept, questions filtered, inner join, answer score filtered;
* ``top_pairs_sql_path`` -- the export-query path: plain self-join on
  AcceptedAnswerId = Id, closed questions dropped, TOP n by score, then the
  CSV-to-JSONL conversion (trim, safe ints, md5 id, URL).

Keep-last is ``max_by`` per key (a partial aggregate: a key holding a third of
all rows costs one row per task); the pair join is an equi-join on a unique key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.functions.text import date_prefix, md5_hex, safe_int, strip_unicode, url_for

# The reference's extraction filter.
MIN_Q_SCORE = 5
MIN_A_SCORE = 3
AFTER_DATE = "2020-01-01"
TARGET_TAG = "<python>"
TOP_N = 50_000

POST_FIELDS = ["Id", "PostTypeId", "AcceptedAnswerId", "Score", "Tags", "CreationDate",
               "Title", "Body"]


def keep_last(posts: DataFrame, key_cols: list[str], order_col: str = "seq") -> DataFrame:
    """The last record (by ``order_col``) per key."""
    others = [c for c in posts.columns if c not in key_cols]
    return posts.groupBy(*key_cols).agg(
        F.max_by(F.struct(*others), F.col(order_col)).alias("r")).select(*key_cols, "r.*")


def pairs_from_posts(posts: DataFrame, min_q: int = MIN_Q_SCORE, min_a: int = MIN_A_SCORE,
                     after_date: str = AFTER_DATE, tag: str = TARGET_TAG,
                     drop_closed: bool = False) -> DataFrame:
    """J2 + F1-F3 (+ F4 when ``drop_closed``): qa_pairs (A3) from post rows."""
    typed = keep_last(posts.where(F.col("PostTypeId").isin("1", "2")),
                      ["PostTypeId", "Id"])
    q = typed.where(F.col("PostTypeId") == "1")
    q = q.where((safe_int(F.col("Score")) >= min_q)
                & F.coalesce(F.col("Tags"), F.lit("")).contains(tag)
                & (date_prefix(F.col("CreationDate")) >= F.lit(after_date))
                & F.col("AcceptedAnswerId").isNotNull() & (F.col("AcceptedAnswerId") != ""))
    if drop_closed and "ClosedDate" in posts.columns:
        q = q.where(F.col("ClosedDate").isNull())
    a = typed.where(F.col("PostTypeId") == "2").select(
        F.col("Id").alias("a_id"), F.col("Body").alias("a_body"), F.col("Score").alias("a_score"))
    j = q.join(a, q.AcceptedAnswerId == a.a_id, "inner").where(safe_int(F.col("a_score")) >= min_a)
    return j.select(
        md5_hex(F.col("Id")).alias("doc_id"),
        F.col("Id").alias("question_id"),
        F.coalesce("Title", F.lit("")).alias("question_title"),
        F.coalesce("Body", F.lit("")).alias("question_body"),
        safe_int(F.col("Score")).alias("question_score"),
        F.coalesce("Tags", F.lit("")).alias("tags"),
        date_prefix(F.col("CreationDate")).alias("creation_date"),
        F.coalesce("a_body", F.lit("")).alias("accepted_answer"),
        safe_int(F.col("a_score")).alias("answer_score"),
        url_for(F.col("Id")).alias("question_url"))


def top_pairs_sql_path(posts: DataFrame, n: int | None = None) -> DataFrame:
    """J1 + F1-F4 + L1: the export query (TOP n by question score, ties by
    post position), then K1's conversion of its CSV columns to qa_pairs."""
    return csv_rows_to_pairs(export_rows(posts, n))


def export_rows(posts: DataFrame, n: int | None = None) -> DataFrame:
    """J1 + F1-F4 + L1: the export query's rows (all strings) plus ``seq``;
    the cut to TOP n (by question score, ties by post position) only where ``n`` names it."""
    q = posts.alias("q")
    a = posts.alias("a")
    j = q.join(a, F.col("q.AcceptedAnswerId") == F.col("a.Id"), "inner").where(
        (safe_int(F.col("q.Score")) >= MIN_Q_SCORE)
        & F.col("q.Tags").like(f"%{TARGET_TAG}%")
        & (F.col("q.CreationDate") >= F.lit(AFTER_DATE))
        & F.col("q.ClosedDate").isNull()
        & (safe_int(F.col("a.Score")) >= MIN_A_SCORE))
    export = j.select(
        F.col("q.Id").alias("Id"), F.col("q.Title").alias("Title"), F.col("q.Body").alias("Body"),
        F.col("q.Score").alias("Score"), F.col("q.Tags").alias("Tags"),
        F.substring(F.col("q.CreationDate"), 1, 10).alias("CreationDate"),
        F.col("a.Body").alias("AcceptedAnswerBody"), F.col("a.Score").alias("AnswerScore"),
        F.col("q.seq").alias("seq"))
    if n is None:
        return export
    return export.orderBy(safe_int(F.col("Score")).desc(), F.col("seq")).limit(n)


def csv_rows_to_pairs(rows: DataFrame) -> DataFrame:
    """K1 conversion (P1, P2, P3, P5, F5): export rows (all strings) -> qa_pairs."""
    def s(c):
        return strip_unicode(F.coalesce(F.col(c), F.lit("")))
    qid = s("Id")
    return rows.where(qid != "").select(
        md5_hex(qid).alias("doc_id"), qid.alias("question_id"),
        s("Title").alias("question_title"), s("Body").alias("question_body"),
        safe_int(F.col("Score")).alias("question_score"), s("Tags").alias("tags"),
        s("CreationDate").alias("creation_date"),
        s("AcceptedAnswerBody").alias("accepted_answer"),
        safe_int(F.col("AnswerScore")).alias("answer_score"),
        url_for(qid).alias("question_url"))
