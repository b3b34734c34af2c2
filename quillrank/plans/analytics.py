"""Named log-analytics and profile queries: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.operators import logs, profile
from quillrank.plans.retrieval import clean_corpus
from quillrank.sources import tables


def log_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.with_feedback(tables.query_logs(spark, sf_dir), tables.feedback(spark, sf_dir))


def log_metrics(spark, sf_dir):
    return logs.metrics(log_table(spark, sf_dir))


def judge_score_avg(spark, sf_dir):
    return logs.judge_score_avg(log_table(spark, sf_dir))


def feedback_pct(spark, sf_dir):
    return logs.feedback_pct(log_table(spark, sf_dir))


def query_volume_hourly(spark, sf_dir):
    return logs.query_volume_hourly(log_table(spark, sf_dir))


def latency_by_stage(spark, sf_dir):
    return logs.latency_by_stage(log_table(spark, sf_dir))


def recent_queries(spark, sf_dir):
    return logs.recent_queries(log_table(spark, sf_dir), 20)


def top_rewritten(spark, sf_dir):
    return logs.top_rewritten(log_table(spark, sf_dir), 20)


def feedback_latest(spark, sf_dir):
    """Every log row with the feedback it ends up carrying."""
    return log_table(spark, sf_dir).select("id", "session_id", "user_feedback")


def service_health(spark, sf_dir):
    """A18 over per-stage status rows derived from the log: a stage is ok when
    its mean latency is under 500 ms."""
    lt = log_table(spark, sf_dir)
    status = lt.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("service"), F.col(f"{s}_ms").alias("ms")) for s in logs.STAGES])))
    status = status.groupBy("service").agg((F.avg("ms") < 500).alias("ok"))
    return logs.service_health(status)


def tag_top20(spark, sf_dir):
    return profile.tag_top(clean_corpus(spark, sf_dir), 20)


def score_histogram(spark, sf_dir):
    return profile.histograms(clean_corpus(spark, sf_dir))


def length_describe(spark, sf_dir):
    return profile.length_describe(clean_corpus(spark, sf_dir))


def posts_per_year(spark, sf_dir):
    return profile.posts_per_year(clean_corpus(spark, sf_dir))


def top_post(spark, sf_dir):
    return profile.top_post(clean_corpus(spark, sf_dir))
