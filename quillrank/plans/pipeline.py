"""End-to-end question answering over batches.

Every stage is a frame-to-frame step over all questions at once:
rewrite -> explode sub-queries -> BM25 and dense lists per sub-query ->
RRF -> rerank with the original question -> context -> answer -> judge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.text import pair_text, parse_rewrites
from quillrank.operators import dense, evaluate, fusion
from quillrank.operators.bm25 import bm25_search, doc_filter, with_payload
from quillrank.operators.generate import (answer_prompt, answer_with_client, contexts, extract_answers,
                                          judge_answers, judge_with_client, ragas_proxies, rewrite_with_client,
                                          source_view)
from quillrank.operators.index import Bm25Index, build_index
from quillrank.operators.models import (Models, ScriptedClient, batch_complete, default_rewrite, embed_job,
                                        pair_scorer_job)
from quillrank.operators.requests import split_requests
from quillrank.operators.rerank import SCORE_OUT, coverage_scores, rerank
from quillrank.operators.util import isolated, materialize
from quillrank.operators.validate import TOP_K_MAX
from quillrank.plans.retrieval import (MIN_VOTE_SCORE, POOL, clean_corpus, corpus_vectors, request_legs,
                                       with_embed_text)
from quillrank.sources import tables

TOP_K = 5
PAYLOAD = ["doc_id", "question_id", "question_title", "answer_prose", "answer_code_blocks",
           "question_url", "tags_list", "question_score"]


def rewrite(questions: DataFrame, models: Models = Models()) -> DataFrame:
    """M3 + P18: the questions with ``rewritten_queries``."""
    if models.rewriter:
        return rewrite_with_client(questions, models.rewriter, ["query_id"], models.in_flight)
    raw = default_rewrite(F.col("question"))
    return questions.withColumn("rewritten_queries", parse_rewrites(raw, F.col("question")))


def retrieve(index: Bm25Index, clean: DataFrame, rewritten: DataFrame, pool: int = POOL,
             min_score: int = MIN_VOTE_SCORE, models: Models = Models()) -> DataFrame:
    """Lists 2i (BM25) and 2i+1 (dense) for sub-query i, fused, cut at
    ``pool``.  A question whose rewrite gave no sub-query has no lists."""
    keys = ["query_id", "sub_idx"]
    subq = rewritten.select("query_id", F.posexplode("rewritten_queries").alias("sub_idx", "question"))
    bm = bm25_search(index, subq, top_k=pool, key_cols=keys, min_score=min_score)
    embed = embedder(models)
    # Written, so that a search's tasks run no embedder beside their two workers.
    vecs = materialize(embed(with_embed_text(doc_filter(clean, min_score=min_score)), ["seq"], "text_for_embedding"))
    dn = dense.dense_search(vecs, embed(subq, keys, "question"), top_k=pool, key_cols=keys)
    lists = (bm.select("query_id", "rank", "seq", (F.col("sub_idx") * 2).alias("list_no"))
             .unionByName(dn.select("query_id", "rank", "seq",
                                    (F.col("sub_idx") * 2 + 1).alias("list_no"))))
    # Small (questions x pool rows); scoring and the rerank join both read it.
    lists = with_payload(lists, index.docs, ["doc_id"])
    return materialize(fusion.rrf(lists, ["query_id"], top_n=pool))


def embedder(models: Models):
    """M1: ``embed(frame, keys, text column)`` of the user model, or of the default one."""
    if models.embedder:
        return lambda df, keys, text: embed_job(df, keys, text, models.embedder)
    return dense.hash_embed


def pair_scores(index: Bm25Index, clean: DataFrame, pool: DataFrame, questions: DataFrame, models: Models) -> DataFrame:
    """M2: (query_id, seq, reranker_score) of the user model, or of the default one."""
    if not models.scorer:
        return coverage_scores(index, clean, pool, questions, ["query_id"])
    pairs = (clean.select("seq", pair_text(F.col("question_title"), F.col("answer_prose")).alias("text"))
             .join(pool.select("query_id", "seq"), "seq").join(questions.select("query_id", "question"), "query_id"))
    scored = pair_scorer_job(pairs, ["query_id", "seq"], "question", "text", models.scorer)
    return scored.withColumn("reranker_score", F.col("reranker_score").cast(SCORE_OUT))


def answers_of(rewritten: DataFrame, sources: DataFrame, models: Models, truth_col: str | None = None) -> DataFrame:
    """M4 + M5: the questions with context, ``answer`` and ``judge``."""
    ctx = contexts(sources, ["query_id"])
    if models.answerer:  # written, as an answer costs a call
        answers = materialize(answer_with_client(rewritten, ctx, models.answerer, ["query_id"], models.in_flight))
    else:
        answers = extract_answers(rewritten, ctx, ["query_id"])
    if models.judge:
        return judge_with_client(answers, models.judge, ["query_id"], truth_col, models.in_flight)
    return judge_answers(answers)


def answer_requests(clean: DataFrame, index: Bm25Index, requests: DataFrame, models: Models = Models(),
                    pool: int = POOL, vectors: DataFrame | None = None,
                    date_filter_dense: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """R9 over a request frame (``query_id, question, min_vote_score, tags, after_date, top_k``): answers, sources,
    rejects and the errors of failed searches.

    Broken requests go to the rejects.  Every sub-query of a request is searched under the request's filter; its two
    lists have the numbers 2i and 2i+1.  A search that fails leaves its lists out and its error in the result (R6);
    embedding errors raise.  ``vectors`` (seq, embedding) are the documents' vectors, if they exist already.
    """
    valid, rejects = split_requests(requests)
    rewritten = rewrite(valid, models)
    if models.rewriter:  # written, as a rewrite costs a call
        rewritten = materialize(rewritten)
    keys = ["query_id", "sub_idx"]
    subq = rewritten.select("query_id", "min_vote_score", "tags", "after_date",
                            F.posexplode("rewritten_queries").alias("sub_idx", "question"))
    embed = embedder(models)
    if vectors is None:
        vectors = materialize(embed(with_embed_text(clean), ["seq"], "text_for_embedding"))
    legs = request_legs(index, clean, subq, pool, date_filter_dense, keys, vectors, embed)
    id_type = valid.schema["query_id"].dataType.simpleString()
    errors, lists = {}, None
    for no, (name, build) in enumerate(legs.items()):
        rows, errors[name] = isolated(
            f"search {name}", lambda b=build, no=no: b().select(
                "query_id", "rank", "seq", (F.col("sub_idx") * 2 + no).cast("int").alias("list_no")),
            f"query_id {id_type}, rank int, seq bigint, list_no int")
        lists = rows if lists is None else lists.unionByName(rows)
    fused = materialize(fusion.rrf(with_payload(lists, index.docs, ["doc_id"]), ["query_id"], top_n=pool))
    scores = pair_scores(index, clean, fused, valid, models)
    # Written, so that these few rows are known to be few and go to the texts.
    ranked = materialize(rerank(fused, scores, ["query_id"], top_k=TOP_K_MAX).drop("doc_id")
                         .join(valid.select("query_id", "top_k"), "query_id")
                         .where(F.col("rerank_rank") <= F.col("top_k")).drop("top_k"))
    sources = materialize(with_payload(ranked, clean, PAYLOAD))
    return answers_of(rewritten, sources, models), sources, rejects, {k: e for k, e in errors.items() if e}


def answer_batch(clean: DataFrame, questions: DataFrame, top_k: int = TOP_K,
                 models: Models = Models(), truth_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, sources) for a frame of (query_id, question) over a cleaned corpus under the default filter."""
    index = build_index(clean)
    rewritten = rewrite(questions, models)
    fused = retrieve(index, clean, rewritten, models=models)
    scores = pair_scores(index, clean, fused, questions, models)
    # Written, so that these few rows are known to be few and go to the texts.
    ranked = materialize(rerank(fused, scores, ["query_id"], top_k=top_k).drop("doc_id"))
    sources = materialize(with_payload(ranked, clean, PAYLOAD))
    return answers_of(rewritten, sources, models, truth_col), sources


def pipeline_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R9 for a mixed batch of requests: answer, sources and judgement of each valid one under its own parameters."""
    clean = clean_corpus(spark, sf_dir)
    answers, _, _, errors = answer_requests(clean, build_index(clean), tables.requests(spark, sf_dir))
    if errors:
        raise RuntimeError(f"searches failed: {errors}")
    return answers.select("query_id", "answer",
                          F.coalesce("source_ids", F.array().cast("array<string>")).alias("source_ids"),
                          F.col("judge.relevance").alias("relevance"), F.col("judge.accuracy").alias("accuracy"),
                          F.col("judge.completeness").alias("completeness"))


def pipeline_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer, sources and judgement for every benchmark item."""
    answers, _ = answer_batch(clean_corpus(spark, sf_dir), tables.questions(spark, sf_dir))
    return answers.select("query_id", "answer",
                          F.coalesce("source_ids", F.array().cast("array<string>")).alias("source_ids"),
                          "rewritten_queries",
                          F.col("judge.relevance").alias("relevance"),
                          F.col("judge.accuracy").alias("accuracy"),
                          F.col("judge.completeness").alias("completeness"),
                          F.col("judge.reasoning").alias("reasoning"))


def pipeline_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources each answer cites, as the API returns them."""
    _, sources = answer_batch(clean_corpus(spark, sf_dir), tables.questions(spark, sf_dir))
    return source_view(sources, ["query_id"])


def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generator prompt for every benchmark item."""
    answers, _ = answer_batch(clean_corpus(spark, sf_dir), tables.questions(spark, sf_dir))
    return answers.select("query_id", F.coalesce("n_sources", F.lit(0)).alias("n_sources"),
                          answer_prompt(F.col("question"), F.coalesce("context", F.lit("")))
                          .alias("prompt"))


def _gt_questions(clean: DataFrame, n: int) -> DataFrame:
    # Written: few rows, and read by several branches that would each sort the corpus again.
    gt = materialize(evaluate.build_eval_set(clean, n=n))
    return gt.select(F.col("gt_rank").alias("query_id"), F.col("question_title").alias("question"),
                     "accepted_answer")


def generation_eval(spark: SparkSession, sf_dir: str, models: Models = Models()) -> DataFrame:
    """Judge averages over the ground-truth questions (latency is not
    measured in batch, so its mean is null).  A judge model also sees the accepted answers."""
    clean = clean_corpus(spark, sf_dir)
    gt = _gt_questions(clean, evaluate.GT_SIZE)
    answers, _ = answer_batch(clean, gt, models=models, truth_col="accepted_answer")
    return evaluate.generation_summary(answers.withColumn("total_ms", F.lit(None).cast("int")))


def ragas_eval(spark: SparkSession, sf_dir: str, n: int = 50, models: Models = Models(),
               scorer=ragas_proxies) -> DataFrame:
    """RAGAS-style means.  ``scorer`` adds the four scores to rows of (query_id, question, answer,
    contexts, ground_truths); the default are overlap proxies."""
    clean = clean_corpus(spark, sf_dir)
    gt = _gt_questions(clean, n)
    answers, _ = answer_batch(clean, gt.select("query_id", "question"), models=models)
    rows = answers.join(gt.select("query_id", "accepted_answer"), "query_id").select(
        "query_id", "question", "answer",
        F.coalesce("source_texts", F.array().cast("array<string>")).alias("contexts"),
        F.array(F.col("accepted_answer")).alias("ground_truths"))
    return evaluate.ragas_summary(scorer(rows))


def batch_complete_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: every benchmark item sent to a scripted client with retries."""
    q = tables.questions(spark, sf_dir)
    return batch_complete(q, "question", ScriptedClient, ["query_id"], base_wait=0.0)


def title_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each question's top-3 dense hits, cosine of the question vector
    and the hit's title vector."""
    clean = clean_corpus(spark, sf_dir)
    q = tables.questions(spark, sf_dir)
    vecs = corpus_vectors(clean)
    top3 = dense.dense_search(vecs, dense.hash_embed(q, ["query_id"], "question"), top_k=3)
    qb = dense.hash_buckets(q, ["query_id"], "question")
    tb = dense.hash_buckets(clean, ["seq"], "question_title")
    sims = dense.sparse_cosine(qb, tb, top3.select("query_id", "seq"), "query_id", "seq")
    out = top3.join(sims, ["query_id", "seq"]).join(clean.select("seq", "question_id"), "seq")
    return out.select("query_id", "rank", "question_id", F.round("cos", 6).alias("sim"))
