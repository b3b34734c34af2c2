"""Cleaning of Q&A pairs: qa_pairs -> qa_pairs_clean.

One narrow projection plus one filter -- no shuffle.  Extra input columns are
carried through, as the reference passes unknown fields on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.functions.core import let
from quillrank.functions.html import has_blocks, html_code_blocks, html_to_text, html_without_code
from quillrank.functions.text import (embedding_text, tags_to_array,
                                      truncate_tokens)

# Token limits of the cleaning stage.
MAX_ANSWER_TOKENS = 512
MAX_BODY_TOKENS = 256
MAX_EMBED_TOKENS = 512
MIN_ANSWER_TOKENS = 10


def with_clean_columns(pairs: DataFrame, max_answer_tokens: int | None = MAX_ANSWER_TOKENS,
                       max_body_tokens: int | None = MAX_BODY_TOKENS,
                       max_embed_tokens: int | None = MAX_EMBED_TOKENS) -> DataFrame:
    """Add the five derived fields and a ``keep`` flag; drops nothing.

    The HTML-derived fields come out of a one-row ``inline`` generator: a later
    filter on them cannot be pushed below it, so the regex work runs once per
    row instead of once in the filter and again in the projection.
    """
    raw = F.coalesce(F.col("accepted_answer"), F.lit(""))

    def fields(html, blocks):
        code = F.when(blocks, html_code_blocks(html)).otherwise(F.array().cast("array<string>"))
        rest = F.when(blocks, html_without_code(html)).otherwise(html)
        return F.struct(
            truncate_tokens(html_to_text(rest, blocks), max_answer_tokens).alias("answer_prose"),
            code.alias("answer_code_blocks"),
            truncate_tokens(html_to_text(F.col("question_body")), max_body_tokens)
            .alias("question_prose"),
            tags_to_array(F.col("tags")).alias("tags_list"),
            html.rlike(r"(?U)\S").alias("_has_answer"),
        )

    # Most answers hold no code, comment, script or style; one look tells, and their patterns are left out.
    derived = let(raw, lambda html: let(has_blocks(html), lambda blocks: fields(html, blocks)))
    out = pairs.select("*", F.inline(F.array(derived)))
    out = out.withColumns({
        "text_for_embedding": embedding_text(F.coalesce(F.col("question_title"), F.lit("")),
                                             F.col("tags_list"), F.col("answer_prose"),
                                             max_embed_tokens),
        # ">= 10 tokens" without splitting the whole text: the anchored
        # pattern stops after the tenth token.
        "keep": F.col("_has_answer") & F.coalesce(F.col("answer_prose").rlike(
            rf"(?U)^\s*(\S+\s+){{{MIN_ANSWER_TOKENS - 1}}}\S"), F.lit(False)),
    })
    return out.drop("_has_answer")


def clean_pairs(pairs: DataFrame, **limits) -> DataFrame:
    """F6 applied: blank answers and answers under 10 tokens are dropped."""
    return with_clean_columns(pairs, **limits).where(F.col("keep")).drop("keep")


def ingest_counts(pairs: DataFrame, **limits) -> DataFrame:
    """One row (total, kept, filtered) -- a single aggregation pass."""
    flagged = with_clean_columns(pairs, **limits)
    return flagged.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("keep")).alias("kept"),
        F.count_if(~F.col("keep")).alias("filtered"),
    )
