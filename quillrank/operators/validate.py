"""Request validation and normalisation.

A batch of requests is split into a valid frame and a reject frame carrying
the list of broken rules -- a projection and a filter, no per-row Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Request limits and the UI's date presets (label, bound).
QUESTION_MIN, QUESTION_MAX = 10, 1000
SCORE_MIN, SCORE_MAX = 0, 500
TOP_K_MIN, TOP_K_MAX = 1, 20
FEEDBACK_MIN, FEEDBACK_MAX = -1, 1
DATE_RE = r"^\d{4}-\d{2}-\d{2}$"
DATE_PRESETS = [("Any", None), ("2020+", "2020-01-01"), ("2022+", "2022-01-01"),
                ("2023+", "2023-01-01"), ("2024+", "2024-01-01")]


def preset_bound(label_col) -> F.Column:
    """preset label -> date bound (a literal map; unknown label -> null)."""
    entries = [x for lab, bound in DATE_PRESETS if bound is not None for x in (F.lit(lab), F.lit(bound))]
    return F.element_at(F.create_map(*entries), label_col)


def request_errors(df: DataFrame) -> DataFrame:
    """add ``errors`` (array of rule names broken) and ``valid``."""
    q, s, d, k = (F.col("question"), F.col("min_vote_score"), F.col("after_date"), F.col("top_k"))
    checks = F.array(
        F.when(q.isNull() | (F.length(q) < QUESTION_MIN), F.lit("question: too short")),
        F.when(F.length(q) > QUESTION_MAX, F.lit("question: too long")),
        F.when((s < SCORE_MIN) | (s > SCORE_MAX), F.lit("min_vote_score: out of range")),
        F.when(d.isNotNull() & ~d.rlike(DATE_RE), F.lit("after_date: bad format")),
        F.when((k < TOP_K_MIN) | (k > TOP_K_MAX), F.lit("top_k: out of range")),
    )
    errors = F.filter(checks, lambda x: x.isNotNull())
    return df.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def feedback_errors(df: DataFrame) -> DataFrame:
    """F9 for feedback rows: value in -1..1."""
    fb = F.col("feedback")
    return df.withColumn("valid", fb.isNotNull() & (fb >= FEEDBACK_MIN) & (fb <= FEEDBACK_MAX))
