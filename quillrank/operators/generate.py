"""Prompt building, answering and judging over question batches
(SURVEY P14-P16, P20, P21, W4, M4, M5, M6, R9).

Per-question lists become sorted arrays built by bounded aggregations: a
question's sources are at most ``top_k`` rows, so ``collect_list`` there is
bounded by the cut, never by the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.functions.text import judge_struct, parse_rewrites, tokens, truncate_tokens
from quillrank.operators.models import NO_SOURCES_ANSWER, CallOptions, batch_complete, default_judge, overlap_share

# Generator context limits and the answer prompt text.
MAX_DOC_TOKENS = 300
MAX_CODE_BLOCKS = 2
ANSWER_PROMPT = (
    "Question: {question}\n\n"
    "--- Stack Overflow Context ---\n"
    "{context}\n"
    "--- End Context ---\n\n"
    "Write a concise, accurate answer. If multiple approaches exist, compare them briefly.\n"
    "End with a Sources section listing the question URLs.")


# The rewriter and judge prompt texts.
REWRITE_PROMPT = (
    "You are a Stack Overflow search expert.\n"
    "Rewrite the developer question into 2-3 focused sub-queries for retrieval.\n"
    "Rules:\n"
    "- Each sub-query targets a distinct aspect of the question\n"
    "- Use technical terms found on Stack Overflow\n"
    "- Max 20 words per sub-query\n"
    "- Return ONLY a JSON array of strings \u2014 nothing else\n\n"
    "Question: {question}\n\n"
    "JSON array:")
JUDGE_PROMPT = (
    "Evaluate this AI answer to a developer question.\n\n"
    "Question: {question}\n"
    "{gt_section}\n"
    "AI Answer: {answer}\n\n"
    "Score each dimension 1 (very poor) to 5 (excellent):\n"
    "1. relevance   \u2014 directly addresses the question?\n"
    "2. accuracy    \u2014 technically correct?\n"
    "3. completeness \u2014 covers key aspects?\n\n"
    "Return ONLY valid JSON \u2014 no text outside the object:\n"
    '{{"relevance": N, "accuracy": N, "completeness": N, "reasoning": "one sentence"}}')
JUDGE_ANSWER_CHARS = 1500
JUDGE_TRUTH_CHARS = 300
# The answering system prompt, and the sampling settings of each stage.
ANSWER_SYSTEM = (
    "You are a senior software engineer answering a developer's technical question. "
    "Use ONLY the Stack Overflow answers provided. "
    "Preserve code blocks verbatim. Do NOT fabricate \u2014 say so if context is insufficient.")
REWRITE_OPTIONS = CallOptions(temperature=0.3, max_tokens=256)
ANSWER_OPTIONS = CallOptions(system=ANSWER_SYSTEM, temperature=0.2, max_tokens=1024)
JUDGE_OPTIONS = CallOptions(temperature=0.0, max_tokens=256)
ANSWER_FAILED = "Answer generation failed: "


def _fill(template: str, **cols) -> F.Column:
    """Substitute ``{name}`` slots of a fixed template with columns."""
    import re
    parts = re.split(r"(\{\w+\})", template.replace("{{", "\0").replace("}}", "\1"))
    out = []
    for p in parts:
        if re.fullmatch(r"\{\w+\}", p):
            out.append(cols[p[1:-1]])
        elif p:
            out.append(F.lit(p.replace("\0", "{").replace("\1", "}")))
    return F.concat(*out)


def rewrite_prompt(question) -> F.Column:
    """The rewriter prompt for each question."""
    return _fill(REWRITE_PROMPT, question=question)


def judge_prompt(question, answer, ground_truth=None) -> F.Column:
    """The judge prompt; answer cut to 1,500 characters, ground truth
    (when given) to 300."""
    gt = F.lit("") if ground_truth is None else F.when(
        F.coalesce(ground_truth, F.lit("")) != "",
        F.concat(F.lit("Ground Truth: "), F.substring(ground_truth, 1, JUDGE_TRUTH_CHARS),
                 F.lit("\n"))).otherwise(F.lit(""))
    return _fill(JUDGE_PROMPT, question=question, gt_section=gt,
                 answer=F.substring(answer, 1, JUDGE_ANSWER_CHARS))


def source_view(sources: DataFrame, key_cols: list[str], rank_col: str = "rerank_rank") -> DataFrame:
    """The API's source projection with defaults for missing fields."""
    return sources.select(
        *key_cols, F.col(rank_col).alias("rank"),
        F.coalesce("doc_id", F.lit("")).alias("doc_id"),
        F.coalesce("question_title", F.lit("")).alias("question_title"),
        F.coalesce("question_url", F.lit("")).alias("question_url"),
        F.coalesce("tags_list", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("question_score", F.lit(0)).alias("question_score"),
        F.coalesce(F.col("rrf_score").cast("double"), F.lit(0.0)).alias("retrieval_score"),
        F.coalesce(F.col("reranker_score").cast("double"), F.lit(0.0)).alias("reranker_score"))


def source_block(rank, title, prose, code_blocks, url):
    """P15 for one source: ``[i] title``, first 300 prose words, at most two
    fenced code blocks, the URL."""
    code = F.coalesce(code_blocks, F.array().cast("array<string>"))
    fenced = F.array_join(F.transform(F.slice(code, 1, MAX_CODE_BLOCKS),
                                      lambda c: F.concat(F.lit("```\n"), c, F.lit("\n```"))), "\n")
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), F.coalesce(title, F.lit("")),
                    F.lit("\n"), truncate_tokens(F.coalesce(prose, F.lit("")), MAX_DOC_TOKENS,
                                                 always_rejoin=True),
                    F.lit("\n"), fenced, F.lit("\nURL: "), F.coalesce(url, F.lit("")))


def contexts(sources: DataFrame, key_cols: list[str], rank_col: str = "rerank_rank") -> DataFrame:
    """(key..., n_sources, context, first_prose, source_ids, source_texts)
    from ranked source rows carrying the payload columns."""
    block = source_block(F.col(rank_col), F.col("question_title"), F.col("answer_prose"),
                         F.col("answer_code_blocks"), F.col("question_url"))
    rows = sources.select(*key_cols, F.struct(
        F.col(rank_col).alias("r"), block.alias("block"), F.col("answer_prose").alias("prose"),
        F.col("question_id").alias("qid"),
        F.concat(F.coalesce("question_title", F.lit("")), F.lit(" "),
                 F.coalesce("answer_prose", F.lit(""))).alias("text")).alias("s"))
    per_q = rows.groupBy(*key_cols).agg(F.array_sort(F.collect_list("s")).alias("srcs"))
    return per_q.select(
        *key_cols, F.size("srcs").alias("n_sources"),
        F.array_join(F.transform("srcs", lambda s: s["block"]), "\n\n").alias("context"),
        F.element_at(F.col("srcs"), 1)["prose"].alias("first_prose"),
        F.transform("srcs", lambda s: s["qid"]).alias("source_ids"),
        F.transform("srcs", lambda s: s["text"]).alias("source_texts"))


def answer_prompt(question, context):
    """The answer prompt."""
    head, rest = ANSWER_PROMPT.split("{question}")
    mid, tail = rest.split("{context}")
    return F.concat(F.lit(head), question, F.lit(mid), context, F.lit(tail))


def extract_answers(questions: DataFrame, ctx: DataFrame, key_cols: list[str]) -> DataFrame:
    """M4 default: the questions with their contexts and ``answer``, the first
    source's whole prose (a fixed sentence without sources)."""
    j = questions.join(ctx, key_cols, "left")
    return j.withColumn("answer", F.when(_has_sources(), F.coalesce(F.col("first_prose"), F.lit("")))
                        .otherwise(F.lit(NO_SOURCES_ANSWER)))


def answer_with_client(questions: DataFrame, ctx: DataFrame, client_factory, key_cols: list[str],
                       in_flight: int = 1, base_wait: float = 2.0) -> DataFrame:
    """M4 with a user model: as ``extract_answers``, by prompt and call.  Questions
    without sources are not sent; a failed call's answer says so, with the error."""
    j = questions.join(ctx, key_cols, "left")
    prompts = j.where(_has_sources()).select(
        *key_cols, answer_prompt(F.coalesce("question", F.lit("")), F.coalesce("context", F.lit(""))).alias("_prompt"))
    done = batch_complete(prompts, "_prompt", client_factory, key_cols, base_wait=base_wait,
                          options=ANSWER_OPTIONS, in_flight=in_flight)
    answer = (F.when(~_has_sources(), F.lit(NO_SOURCES_ANSWER))
              .when(F.col("error").isNotNull(), F.concat(F.lit(ANSWER_FAILED), F.col("error")))
              .otherwise(F.coalesce("completion", F.lit(""))))
    return j.join(done, key_cols, "left").withColumn("answer", answer).drop("completion", "error", "attempts")


def _has_sources() -> F.Column:
    return F.coalesce(F.col("n_sources"), F.lit(0)) > 0


def judge_answers(answers: DataFrame) -> DataFrame:
    """M5 default + P19/P20: ``judge``, null unless some score is present."""
    judged = answers.withColumn("judge", judge_struct(default_judge(F.col("question"), F.col("answer"), _has_sources())))
    return judged.withColumn("judge", F.when(F.coalesce(
        F.col("judge.relevance"), F.col("judge.accuracy"), F.col("judge.completeness")).isNotNull(),
        F.col("judge")))


def answer_and_judge(questions: DataFrame, ctx: DataFrame, key_cols: list[str]) -> DataFrame:
    """M4 + M5 + P19/P20 defaults."""
    return judge_answers(extract_answers(questions, ctx, key_cols))


def ragas_proxies(rows: DataFrame) -> DataFrame:
    """M6 defaults (token-overlap proxies, labelled as such):
    faithfulness = answer words found in the contexts; answer_relevancy =
    question words found in the answer; context_precision = share of contexts
    sharing a word with the ground truth; context_recall = ground-truth words
    found in the contexts."""
    def toks(c):
        return tokens(F.lower(c))
    ctx_words = F.flatten(F.transform("contexts", lambda c: toks(c)))
    gt_words = F.flatten(F.transform("ground_truths", lambda c: toks(c)))
    n_ctx = F.size("contexts")
    prec = F.when(n_ctx > 0, F.size(F.filter("contexts", lambda c: F.size(
        F.array_intersect(F.array_distinct(toks(c)), F.array_distinct(gt_words))) > 0)).cast("double")
        / n_ctx.cast("double")).otherwise(F.lit(0.0))
    return rows.select(
        "*",
        overlap_share(toks(F.col("answer")), ctx_words).alias("faithfulness"),
        overlap_share(toks(F.col("question")), toks(F.col("answer"))).alias("answer_relevancy"),
        prec.alias("context_precision"),
        overlap_share(gt_words, ctx_words).alias("context_recall"))


def rewrite_with_client(questions: DataFrame, client_factory, key_cols: list[str],
                        in_flight: int = 1) -> DataFrame:
    """M3 with a user model: prompt -> batch completion -> P17/P18 parsing.
    A failed call falls back to ``[question]``, as the reference does."""
    prompts = questions.withColumn("_prompt", rewrite_prompt(F.col("question")))
    done = batch_complete(prompts, "_prompt", client_factory, key_cols, options=REWRITE_OPTIONS, in_flight=in_flight)
    return questions.join(done, key_cols, "left").withColumn(
        "rewritten_queries",
        parse_rewrites(F.coalesce("completion", F.lit("")), F.col("question"))).drop(
        "completion", "error", "attempts")


def judge_with_client(answers: DataFrame, client_factory, key_cols: list[str],
                      truth_col: str | None = None, in_flight: int = 1) -> DataFrame:
    """M5 with a user model: judge prompt -> batch completion -> P19 parsing;
    a failed call gives the null judgement ('judge error')."""
    gt = F.col(truth_col) if truth_col else None
    prompts = answers.withColumn("_prompt", judge_prompt(F.col("question"), F.col("answer"), gt))
    done = batch_complete(prompts, "_prompt", client_factory, key_cols, options=JUDGE_OPTIONS, in_flight=in_flight)
    return answers.join(done, key_cols, "left").withColumn(
        "judge", judge_struct(F.coalesce("completion", F.lit("")))).drop(
        "completion", "error", "attempts")
