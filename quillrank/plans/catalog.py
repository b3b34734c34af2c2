"""The query catalogue: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from quillrank.plans import analytics, evaluation, ingest, pipeline, retrieval
from quillrank.streaming import logs_stream

QUERIES = {
    "bm25_topk": retrieval.bm25_topk,
    "bm25_filtered": retrieval.bm25_filtered,
    "bm25_zero_fill": retrieval.bm25_zero_fill,
    "term_stats": retrieval.term_stats,
    "postings_stats": retrieval.postings_stats,
    "dense_topk": retrieval.dense_topk,
    "dense_topk_filtered": retrieval.dense_topk_filtered,
    "embed_hash": retrieval.embed_hash,
    "rrf_fusion": retrieval.rrf_fusion,
    "hybrid_retrieve": retrieval.hybrid_retrieve,
    "rerank_topk": retrieval.rerank_topk,
    "hybrid_requests": retrieval.hybrid_requests,
    "request_rejects": retrieval.request_rejects,
    "build_eval_set": evaluation.build_eval_set,
    "retrieval_eval": evaluation.retrieval_eval,
    "method_comparison": evaluation.method_comparison,
    "rrf_contributions": evaluation.rrf_contributions,
    "prompt_context": pipeline.prompt_context,
    "pipeline_answers": pipeline.pipeline_answers,
    "pipeline_sources": pipeline.pipeline_sources,
    "pipeline_requests": pipeline.pipeline_requests,
    "generation_eval": pipeline.generation_eval,
    "ragas_eval": pipeline.ragas_eval,
    "batch_complete": pipeline.batch_complete_query,
    "title_similarity": pipeline.title_similarity,
    "qa_pairs_join": ingest.qa_pairs_join,
    "posts_self_join_top": ingest.posts_self_join_top,
    "csv_roundtrip": ingest.csv_roundtrip,
    "xml_roundtrip": ingest.xml_roundtrip,
    "index_roundtrip": ingest.index_roundtrip,
    "gt_roundtrip": ingest.gt_roundtrip,
    "vectors_roundtrip": ingest.vectors_roundtrip,
    "vectors_upsert": ingest.vectors_upsert,
    "clean_sink": ingest.clean_sink,
    "metrics_roundtrip": ingest.metrics_roundtrip,
    "log_roundtrip": ingest.log_roundtrip,
    "safe_int": ingest.safe_ints,
    "doc_ids": ingest.doc_ids,
    "html_to_text": ingest.html_text,
    "code_blocks": ingest.code_blocks,
    "clean_records": ingest.clean_records,
    "ingest_counts": ingest.ingest_count,
    "parse_rewrites": ingest.parse_rewrite,
    "parse_judge": ingest.parse_judge,
    "validate_requests": ingest.validate_requests,
    "stream_query_volume": logs_stream.stream_query_volume,
    "stream_feedback": logs_stream.stream_feedback,
    "stream_clean": logs_stream.stream_clean,
    "log_metrics": analytics.log_metrics,
    "judge_score_avg": analytics.judge_score_avg,
    "feedback_pct": analytics.feedback_pct,
    "query_volume_hourly": analytics.query_volume_hourly,
    "latency_by_stage": analytics.latency_by_stage,
    "recent_queries": analytics.recent_queries,
    "top_rewritten": analytics.top_rewritten,
    "feedback_latest": analytics.feedback_latest,
    "service_health": analytics.service_health,
    "tag_top20": analytics.tag_top20,
    "score_histogram": analytics.score_histogram,
    "length_describe": analytics.length_describe,
    "posts_per_year": analytics.posts_per_year,
    "top_post": analytics.top_post,
}
