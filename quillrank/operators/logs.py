"""Query-log analytics.

The log is append-only; feedback arrives later as its own rows.  The
reference's ``UPDATE ... WHERE session_id`` is re-expressed as a join: a log
row carries the session's last feedback if that feedback came at or after the
row was logged (an update only touches rows that exist at the time).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.functions.text import left

STAGES = ["rewrite", "retrieval", "reranker", "generation", "judge"]


# Columns of a result that a log row takes over as they are named there.
JUDGE_FIELDS = {"judge_relevance": "relevance", "judge_accuracy": "accuracy",
                "judge_completeness": "completeness", "judge_reasoning": "reasoning"}
TIMINGS = [f"{s}_ms" for s in STAGES] + ["total_ms"]


def log_rows(results: DataFrame) -> DataFrame:
    """K7: pipeline results -> query-log rows.  ``judge`` and ``timings`` may be null or absent, which leaves their
    fields null; a result without a ``session_id`` gets one of its own."""
    have = set(results.columns)
    timed = set(results.schema["timings"].dataType.names) if "timings" in have else set()
    judge = {out: F.col("judge")[name] if "judge" in have else F.lit(None).cast("string" if name == "reasoning" else "int")
             for out, name in JUDGE_FIELDS.items()}
    times = {t: (F.col("timings")[t] if t in timed else F.lit(None)).cast("int") for t in TIMINGS}
    session = F.coalesce("session_id", F.uuid()) if "session_id" in have else F.uuid()
    stamp = F.current_timestamp().cast("timestamp_ntz")
    return results.select(
        session.alias("session_id"), (F.coalesce("timestamp", stamp) if "timestamp" in have else stamp).alias("timestamp"),
        "question", F.coalesce("answer", F.lit("")).alias("answer"),
        *[c.alias(n) for n, c in (judge | times).items()], F.lit(None).cast("int").alias("user_feedback"))


def last_feedback(feedback: DataFrame) -> DataFrame:
    """Last feedback per session by (ts, seq) -- one partial aggregate,
    so a session holding a third of all rows costs one row per task."""
    return feedback.groupBy("session_id").agg(
        F.max_by("feedback", F.struct("ts", "seq")).alias("last_feedback"),
        F.max(F.struct("ts", "seq")).getField("ts").alias("last_ts"))


def with_feedback(logs: DataFrame, feedback: DataFrame) -> DataFrame:
    """``user_feedback`` filled from the session's last feedback."""
    lf = last_feedback(feedback)
    joined = logs.join(lf, "session_id", "left")
    fb = F.when(F.col("last_ts") >= F.col("timestamp"), F.col("last_feedback"))
    return joined.withColumn("user_feedback", fb.cast("int")).drop("last_feedback", "last_ts")


def metrics(logs: DataFrame) -> DataFrame:
    """A4: the API's metrics row."""
    return logs.agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.round(F.avg("judge_relevance"), 2).alias("avg_relevance"),
        F.round(F.avg("judge_accuracy"), 2).alias("avg_accuracy"),
        F.round(F.avg("judge_completeness"), 2).alias("avg_completeness"),
        F.round(F.avg("total_ms"), 0).alias("avg_latency_ms"),
        F.round(F.lit(100.0) * F.sum(F.when(F.col("user_feedback") == 1, 1).otherwise(0))
                / F.greatest(F.count("user_feedback"), F.lit(1)), 1).alias("feedback_pct"))


def judge_score_avg(logs: DataFrame) -> DataFrame:
    """Mean of (r+a+c)/3 over judged rows; a null part skips the row."""
    judged = logs.where(F.col("judge_relevance").isNotNull())
    s = F.col("judge_relevance") + F.col("judge_accuracy") + F.col("judge_completeness")
    return judged.agg(F.round(F.avg(s) / F.lit(3.0), 2).alias("score"))


def feedback_pct(logs: DataFrame) -> DataFrame:
    """Positive share of rated rows; no ratings -> null."""
    rated = logs.where(F.col("user_feedback").isNotNull())
    return rated.agg(F.round(
        F.lit(100.0) * F.sum(F.when(F.col("user_feedback") == 1, 1).otherwise(0))
        / F.nullif(F.count("user_feedback"), F.lit(0)), 1).alias("pct"))


def query_volume_hourly(logs: DataFrame) -> DataFrame:
    """A5: queries per hour (empty hours absent)."""
    return (logs.groupBy(F.date_trunc("hour", "timestamp").alias("time"))
            .agg(F.count(F.lit(1)).alias("queries")).orderBy("time"))


def latency_by_stage(logs: DataFrame) -> DataFrame:
    """One scan, unpivoted to a row per stage, mean rounded to int."""
    long = logs.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("stage"), F.col(f"{s}_ms").alias("ms")) for s in STAGES])))
    return long.groupBy("stage").agg(F.round(F.avg("ms"), 0).cast("int").alias("ms"))


def recent_queries(logs: DataFrame, n: int = 20) -> DataFrame:
    """The newest ``n`` rows (ties by id), question cut to 80 chars."""
    return (logs.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(n)
            .select("timestamp", left(F.col("question"), 80).alias("question"),
                    "judge_relevance", "judge_accuracy", "judge_completeness", "total_ms"))


def top_rewritten(logs: DataFrame, n: int = 20) -> DataFrame:
    """Most frequent rewritten sub-queries (count desc, value asc)."""
    return (logs.select(F.explode("rewritten_queries").alias("tag_word"))
            .groupBy("tag_word").agg(F.count(F.lit(1)).alias("occurrences"))
            .orderBy(F.col("occurrences").desc(), F.col("tag_word")).limit(n))


def service_health(status: DataFrame) -> DataFrame:
    """Healthy when every service is ok."""
    return status.agg(
        F.when(F.bool_and("ok"), F.lit("healthy")).otherwise(F.lit("degraded")).alias("status"),
        F.count(F.lit(1)).alias("n_services"),
        F.count_if(~F.col("ok")).alias("n_down"))
