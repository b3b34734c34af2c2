"""Corpus profiles over the cleaned pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.functions.text import clip_upper, token_count, year_of

N_BINS = 40
# Clip bounds of the three profiled measures.
CLIPS = {"question_score": 200, "answer_score": 100, "ans_len": 600}


def tag_top(clean: DataFrame, n: int = 20) -> DataFrame:
    """A10: most frequent tags (count desc, tag asc)."""
    return (clean.select(F.explode("tags_list").alias("tag"))
            .groupBy("tag").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), "tag").limit(n))


def measures(clean: DataFrame) -> DataFrame:
    """The three clipped measures, long form: (metric, x)."""
    cols = {"question_score": F.col("question_score"), "answer_score": F.col("answer_score"),
            "ans_len": token_count(F.col("answer_prose"))}
    return clean.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("metric"), clip_upper(v, CLIPS[k]).cast("double").alias("x"))
        for k, v in cols.items()]))).where(F.col("x").isNotNull())


def histograms(clean: DataFrame, bins: int = N_BINS) -> DataFrame:
    """Equal-width histograms over [min, max] of each clipped measure,
    last bin closed, empty bins kept.  One scan for the ranges, one for the
    counts; the bin table is ``metrics x bins`` rows."""
    m = measures(clean)
    ranges = m.groupBy("metric").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    idx = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(
        F.floor((F.col("x") - F.col("lo")) * (F.lit(float(bins)) / (F.col("hi") - F.col("lo")))),
        F.lit(bins - 1))).cast("int")
    counts = (m.join(F.broadcast(ranges), "metric").select("metric", idx.alias("bin"))
              .groupBy("metric", "bin").agg(F.count(F.lit(1)).alias("n")))
    grid = ranges.select("metric", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
                         .alias("bin"))
    return (grid.join(counts, ["metric", "bin"], "left")
            .select("metric", "bin",
                    F.round(F.col("lo") + F.col("bin") * width, 6).alias("bin_lo"),
                    F.round(F.col("lo") + (F.col("bin") + 1) * width, 6).alias("bin_hi"),
                    F.coalesce(F.col("n"), F.lit(0)).alias("count")))


def length_describe(clean: DataFrame) -> DataFrame:
    """describe() of answer token counts, one decimal."""
    n = token_count(F.col("answer_prose"))
    q = F.percentile(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return clean.agg(F.count(n).cast("double").alias("count"), F.avg(n).alias("mean"),
                     F.stddev_samp(n).alias("std"), F.min(n).cast("double").alias("min"),
                     q.alias("q"), F.max(n).cast("double").alias("max")).select(
        *[F.round(c, 1).alias(c) for c in ("count", "mean", "std", "min")],
        F.round(F.col("q")[0], 1).alias("p25"), F.round(F.col("q")[1], 1).alias("p50"),
        F.round(F.col("q")[2], 1).alias("p75"), F.round("max", 1).alias("max"))


def posts_per_year(clean: DataFrame) -> DataFrame:
    """Posts per creation year; unparseable dates dropped."""
    return (clean.select(year_of(F.col("creation_date")).alias("year"))
            .where(F.col("year").isNotNull())
            .groupBy("year").agg(F.count(F.lit(1)).alias("posts")).orderBy("year"))


def top_post(clean: DataFrame) -> DataFrame:
    """The highest-scored pair (ties: corpus order), answer cut to 500 chars."""
    return (clean.orderBy(F.col("question_score").desc(), F.col("seq")).limit(1)
            .select("question_id", "question_title", "tags_list", "question_score",
                    F.substring("answer_prose", 1, 500).alias("answer_head")))
