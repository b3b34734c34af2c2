"""Oracle SQL (DuckDB) for each registered query; same column names as Spark."""

from __future__ import annotations

from quillrank.plans import duck

_CLEAN = f"clean AS ({duck.clean_corpus()}),"
_LOG = f"WITH lg AS ({duck.LOG_TABLE})"
D = "CAST({} AS DOUBLE)".format


_BM_DOCS = "SELECT seq, question_title, answer_prose FROM clean"
FILTER_SQL = ("coalesce(question_score, 0) >= 20 AND list_has_any(coalesce(tags_list, []), ['en', 'de']) "
              "AND coalesce(creation_date, '') >= '2021-06-01'")


def _bm25(top_k: int, allowed: str, queries: str = duck.QUESTIONS) -> str:
    return f"""
WITH {_CLEAN} {duck.bm25_ctes(_BM_DOCS, queries)}
SELECT r.query_id, CAST(r.rank AS INTEGER) AS rank, c.doc_id, c.question_id, CAST(r.score AS DOUBLE) AS score
FROM ({duck.bm25_ranked(allowed, queries, top_k)}) r JOIN clean c USING (seq)"""


def _hybrid_lists(top_k: int, queries: str = duck.QUESTIONS) -> str:
    """CTEs (after clean + bm25 CTEs): hl = union of BM25 (0) and dense (1) lists."""
    allowed = "SELECT seq FROM clean WHERE coalesce(question_score, 0) >= 5"
    dense_docs = "SELECT seq, text_for_embedding FROM clean WHERE coalesce(question_score, 0) >= 5"
    return f"""
hl AS (
  SELECT query_id, 0 AS list_no, rank, seq FROM ({duck.bm25_ranked(allowed, queries, top_k)})
  UNION ALL
  SELECT query_id, 1 AS list_no, rank, seq FROM ({duck.dense_ranked(dense_docs, queries, top_k)}))"""


_QIDF = """
qidf AS (SELECT q.query_id, q.term, coalesce(CAST(CASE WHEN ts.raw_idf < 0 THEN CAST(0.25 AS DOUBLE) * s.mean_idf
                ELSE ts.raw_idf END AS DECIMAL(28,12)), CAST(0 AS DECIMAL(28,12))) AS idf
         FROM (SELECT DISTINCT query_id, term FROM qterms) q LEFT JOIN term_stats ts USING (term), stats s)"""


def _rerank_ctes(pool: str, top_k: int) -> str:
    """CTEs qidf, tot, hit, sc, rr: coverage scores of ``pool`` rows and the cut."""
    return f"""{_QIDF},
tot AS (SELECT query_id, sum(idf) AS total FROM qidf GROUP BY query_id),
hit AS (SELECT p.query_id, p.seq, sum(q.idf) AS hit FROM {pool} p JOIN qidf q USING (query_id)
        WHERE EXISTS (SELECT 1 FROM postings x WHERE x.seq = p.seq AND x.term = q.term) GROUP BY p.query_id, p.seq),
sc AS (SELECT p.query_id, p.seq, p.fused_rank,
              CAST(CASE WHEN t.total > 0 THEN CAST(coalesce(h.hit, 0) AS DOUBLE) / CAST(t.total AS DOUBLE) ELSE 0.0 END
                   AS DECIMAL(18,6)) AS reranker_score
       FROM {pool} p LEFT JOIN hit h USING (query_id, seq) LEFT JOIN tot t USING (query_id)),
rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reranker_score DESC, fused_rank)
                             AS rerank_rank FROM sc) WHERE rerank_rank <= {top_k})"""


_GT = """
gt AS (SELECT row_number() OVER (ORDER BY question_score DESC, seq) AS gt_rank, *
       FROM (SELECT * FROM clean WHERE coalesce(question_score, 0) >= 50 ORDER BY question_score DESC, seq LIMIT 100))"""
_GTQ = "SELECT gt_rank AS query_id, question_title AS question FROM gt"


def _evaluation() -> dict[str, str]:
    base = f"""WITH {_CLEAN} {_GT}, {duck.bm25_ctes(_BM_DOCS, _GTQ)}, {_hybrid_lists(10, _GTQ)},
pool AS ({duck.rrf_fused('SELECT * FROM hl', 20)}), {_rerank_ctes('pool', 10)},
lists AS (SELECT 'bm25' AS method, query_id, rank, seq FROM hl WHERE list_no = 0
          UNION ALL SELECT 'dense', query_id, rank, seq FROM hl WHERE list_no = 1
          UNION ALL SELECT 'hybrid', query_id, rerank_rank, seq FROM rr)"""
    return {
        "build_eval_set": f"""WITH {_CLEAN} {_GT}
SELECT CAST(gt_rank AS INTEGER) AS gt_rank, question_id, question_title, question_prose AS question_body,
       question_url, answer_prose AS accepted_answer, tags_list, question_score FROM gt""",
        "retrieval_eval": f"""{base},
per_q AS (
  SELECT m.method, g.gt_rank, min(l.rank) AS gold_rank
  FROM gt g CROSS JOIN (SELECT unnest(['bm25', 'dense', 'hybrid']) AS method) m
  LEFT JOIN (SELECT l.*, c.question_id FROM lists l JOIN clean c USING (seq)) l
    ON l.method = m.method AND l.query_id = g.gt_rank AND l.question_id = g.question_id
  GROUP BY m.method, g.gt_rank)
SELECT method,
       round(CAST(sum(CASE WHEN gold_rank <= 5 THEN 1 ELSE 0 END) AS DOUBLE) / greatest(count(*), 1), 4) AS hit_rate_at_5,
       round(CAST(sum(CASE WHEN gold_rank <= 10 THEN 1 ELSE 0 END) AS DOUBLE) / greatest(count(*), 1), 4) AS hit_rate_at_10,
       round(sum(CASE WHEN gold_rank IS NOT NULL THEN CAST(1.0 AS DOUBLE) / CAST(gold_rank AS DOUBLE) ELSE 0.0 END)
             / greatest(count(*), 1), 4) AS mrr,
       greatest(count(*), 1) AS n_questions
FROM per_q GROUP BY method""",
        "method_comparison": f"""{base},
all5 AS (SELECT method, query_id, rank, seq FROM lists WHERE method <> 'hybrid' AND rank <= 5
         UNION ALL SELECT 'hybrid', query_id, fused_rank, seq FROM pool WHERE fused_rank <= 5
         UNION ALL SELECT 'reranked', query_id, rerank_rank, seq FROM rr WHERE rerank_rank <= 5),
grid AS (SELECT g.gt_rank AS query_id, g.seq AS gold_seq, m.method FROM gt g
         CROSS JOIN (SELECT unnest(['bm25', 'dense', 'hybrid', 'reranked']) AS method) m)
SELECT CAST(g.query_id AS INTEGER) AS query_id, g.method, min(a.rank) IS NOT NULL AS found,
       CAST(min(a.rank) AS INTEGER) AS rank
FROM grid g LEFT JOIN all5 a ON a.query_id = g.query_id AND a.method = g.method AND a.seq = g.gold_seq
GROUP BY g.query_id, g.method""",
        "rrf_contributions": f"""WITH {_CLEAN} {_GT}, {duck.bm25_ctes(_BM_DOCS, _GTQ)}, {_hybrid_lists(10, _GTQ)},
f AS ({duck.rrf_fused('SELECT * FROM hl', 10)}),
parts AS (SELECT query_id, seq,
                 sum(CASE WHEN list_no = 0 THEN CAST(CAST(1.0 AS DOUBLE) / (CAST(60.0 AS DOUBLE) + CAST(rank AS DOUBLE)) AS DECIMAL(28,15)) END) AS bm25_part,
                 sum(CASE WHEN list_no = 1 THEN CAST(CAST(1.0 AS DOUBLE) / (CAST(60.0 AS DOUBLE) + CAST(rank AS DOUBLE)) AS DECIMAL(28,15)) END) AS dense_part
          FROM hl GROUP BY query_id, seq)
SELECT CAST(f.query_id AS INTEGER) AS query_id, CAST(f.fused_rank AS INTEGER) AS fused_rank, c.question_id,
       round(CAST(f.rrf_score AS DOUBLE), 6) AS rrf_score,
       round(CAST(coalesce(p.bm25_part, 0) AS DOUBLE), 6) AS bm25_part,
       round(CAST(coalesce(p.dense_part, 0) AS DOUBLE), 6) AS dense_part
FROM f LEFT JOIN parts p USING (query_id, seq) JOIN clean c USING (seq)""",
    }


def _request_ctes() -> str:
    """CTEs through ``rr``: the valid requests' reranked sources, each request under its own filter."""
    return f"""WITH {_CLEAN} valid AS (SELECT * FROM ({duck.REQUESTS}) WHERE len(errors) = 0),
{duck.bm25_ctes(_BM_DOCS, 'SELECT query_id, question FROM valid')},
ok AS (SELECT v.query_id, c.seq FROM valid v JOIN clean c ON coalesce(c.question_score, 0) >= v.min_vote_score
       AND (len(v.tags) = 0 OR list_has_any(coalesce(c.tags_list, []), v.tags))
       AND (v.after_date IS NULL OR coalesce(c.creation_date, '') >= v.after_date)),
bm AS (SELECT query_id, seq, floor(CAST(sum(coalesce(c, 0)) + 500 AS DOUBLE) / CAST(1000 AS DOUBLE)) / CAST(1e6 AS DOUBLE) AS score
       FROM ok LEFT JOIN contrib USING (query_id, seq) GROUP BY query_id, seq),
hd AS ({duck.hash_sparse('SELECT seq, text_for_embedding FROM clean', 'seq', 'text_for_embedding')}),
hq AS ({duck.hash_sparse('SELECT query_id, question FROM valid', 'query_id', 'question')}),
nd AS (SELECT seq, sqrt(CAST(sum(cnt * cnt) AS DOUBLE)) AS n FROM hd GROUP BY seq),
nq AS (SELECT query_id, sqrt(CAST(sum(cnt * cnt) AS DOUBLE)) AS n FROM hq GROUP BY query_id),
dots AS (SELECT query_id, seq, sum(hq.cnt * hd.cnt) AS dot FROM hq JOIN hd USING (bucket) GROUP BY query_id, seq),
dn AS (SELECT query_id, seq, CAST(coalesce(CAST(dot AS DOUBLE), 0) / (nd.n * nq.n) AS DECIMAL(18,6)) AS score
       FROM ok JOIN nd USING (seq) JOIN nq USING (query_id) LEFT JOIN dots USING (query_id, seq)),
hl AS (SELECT * FROM (SELECT query_id, 0 AS list_no, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rank, seq FROM bm)
       WHERE rank <= 40 UNION ALL
       SELECT * FROM (SELECT query_id, 1 AS list_no, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rank, seq FROM dn)
       WHERE rank <= 40),
pool AS ({duck.rrf_fused('SELECT * FROM hl', 40)}), {_rerank_ctes('pool', 20)}"""


def _retrieval() -> dict[str, str]:
    ntok = duck.tokens("text")
    last_word = f"SELECT item_id AS query_id, list_extract({ntok}, -1) AS question FROM benchmark"
    first8 = f"array_to_string(list_slice({ntok}, 1, 8), ' ')"
    two = (f"SELECT item_id AS query_id, 0 AS list_no, text AS question FROM benchmark UNION ALL "
           f"SELECT item_id AS query_id, 1 AS list_no, {first8} AS question FROM benchmark")
    filt_docs = f"SELECT * FROM clean WHERE {FILTER_SQL}"
    qidf = """
qidf AS (SELECT q.query_id, q.term, coalesce(CAST(CASE WHEN ts.raw_idf < 0 THEN CAST(0.25 AS DOUBLE) * s.mean_idf
                ELSE ts.raw_idf END AS DECIMAL(28,12)), CAST(0 AS DECIMAL(28,12))) AS idf
         FROM (SELECT DISTINCT query_id, term FROM qterms) q LEFT JOIN term_stats ts USING (term), stats s)"""
    return {
        "bm25_zero_fill": _bm25(10, "SELECT seq FROM clean", last_word),
        "term_stats": f"""WITH {_CLEAN} {duck.bm25_ctes(_BM_DOCS, duck.QUESTIONS)}
SELECT term, n_t, round(raw_idf, 6) AS idf FROM term_stats""",
        "postings_stats": f"""WITH {_CLEAN} {duck.bm25_ctes(_BM_DOCS, duck.QUESTIONS)}
SELECT c.question_id, CAST(p.dl AS INTEGER) AS dl, count(*) AS n_terms, CAST(max(p.tf) AS INTEGER) AS max_tf
FROM postings p JOIN clean c USING (seq) GROUP BY c.question_id, p.dl""",
        "dense_topk": """
WITH c AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS v
           FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings)
           GROUP BY label, pos),
q AS (SELECT label AS query_id, list(v ORDER BY pos) AS qv FROM c GROUP BY label),
d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS dv FROM embeddings),
s AS (SELECT query_id, vec_id, CAST(CASE WHEN sqrt(list_dot_product(dv, dv)) * sqrt(list_dot_product(qv, qv)) > 0
             THEN list_dot_product(dv, qv) / (sqrt(list_dot_product(dv, dv)) * sqrt(list_dot_product(qv, qv)))
             ELSE 0 END AS DECIMAL(18,6)) AS score FROM q, d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS DOUBLE) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10""",
        "dense_topk_filtered": f"""WITH {_CLEAN[:-1]}
SELECT r.query_id, CAST(r.rank AS INTEGER) AS rank, c.doc_id, c.question_id, CAST(r.score AS DOUBLE) AS score
FROM ({duck.dense_ranked(filt_docs, duck.QUESTIONS, 10)}) r JOIN clean c USING (seq)""",
        "embed_hash": f"""WITH {_CLEAN[:-1]}
{duck.hash_sparse('SELECT question_id, text_for_embedding FROM clean', 'question_id', 'text_for_embedding')}""",
        "rrf_fusion": f"""WITH {_CLEAN} {duck.bm25_ctes(_BM_DOCS, two, key='query_id, list_no')},
lists AS ({duck.bm25_ranked('SELECT seq FROM clean', two, 10, key='query_id, list_no')})
SELECT f.query_id, CAST(f.fused_rank AS INTEGER) AS fused_rank, c.doc_id, CAST(f.rrf_score AS DOUBLE) AS rrf_score,
       CAST(f.first_list AS INTEGER) AS first_list, CAST(f.first_rank AS INTEGER) AS first_rank
FROM ({duck.rrf_fused('SELECT query_id, list_no, rank, seq FROM lists')}) f JOIN clean c USING (seq)""",
        "hybrid_retrieve": f"""WITH {_CLEAN} {duck.bm25_ctes(_BM_DOCS, duck.QUESTIONS)}, {_hybrid_lists(40)}
SELECT f.query_id, CAST(f.fused_rank AS INTEGER) AS fused_rank, c.doc_id, CAST(f.rrf_score AS DOUBLE) AS rrf_score
FROM ({duck.rrf_fused('SELECT * FROM hl', 40)}) f JOIN clean c USING (seq)""",
        "request_rejects": f"""SELECT query_id, array_to_string(errors, '; ') AS errors FROM ({duck.REQUESTS}) WHERE len(errors) > 0""",
        "hybrid_requests": f"""{_request_ctes()}
SELECT query_id, CAST(rerank_rank AS INTEGER) AS rerank_rank, c.doc_id, CAST(reranker_score AS DOUBLE) AS reranker_score,
       CAST(fused_rank AS INTEGER) AS fused_rank
FROM rr JOIN clean c USING (seq) JOIN valid USING (query_id) WHERE rerank_rank <= top_k""",
        "rerank_topk": f"""WITH {_CLEAN} {duck.bm25_ctes(_BM_DOCS, duck.QUESTIONS)}, {_hybrid_lists(10)},
pool AS ({duck.rrf_fused('SELECT * FROM hl', 20)}), {qidf},
tot AS (SELECT query_id, sum(idf) AS total FROM qidf GROUP BY query_id),
hit AS (SELECT p.query_id, p.seq, sum(q.idf) AS hit FROM pool p JOIN qidf q USING (query_id)
        WHERE EXISTS (SELECT 1 FROM postings x WHERE x.seq = p.seq AND x.term = q.term) GROUP BY p.query_id, p.seq),
sc AS (SELECT p.query_id, p.seq, p.fused_rank,
              CAST(CASE WHEN t.total > 0 THEN CAST(coalesce(h.hit, 0) AS DOUBLE) / CAST(t.total AS DOUBLE) ELSE 0.0 END
                   AS DECIMAL(18,6)) AS reranker_score
       FROM pool p LEFT JOIN hit h USING (query_id, seq) LEFT JOIN tot t USING (query_id))
SELECT r.query_id, CAST(r.rerank_rank AS INTEGER) AS rerank_rank, c.doc_id,
       CAST(r.reranker_score AS DOUBLE) AS reranker_score, CAST(r.fused_rank AS INTEGER) AS fused_rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reranker_score DESC, fused_rank) AS rerank_rank
      FROM sc) r JOIN clean c USING (seq) WHERE r.rerank_rank <= 10""",
    }


def _logs() -> dict[str, str]:
    pos = "sum(CASE WHEN user_feedback=1 THEN 1 ELSE 0 END)"
    unpivot = " UNION ALL ".join(f"SELECT '{s}' AS stage, {s}_ms AS ms FROM lg" for s in duck.STAGES)
    return {
        "log_metrics": f"""{_LOG}
SELECT count(*) AS total_queries, round(avg(judge_relevance),2) AS avg_relevance,
       round(avg(judge_accuracy),2) AS avg_accuracy, round(avg(judge_completeness),2) AS avg_completeness,
       round(avg(total_ms),0) AS avg_latency_ms,
       round({D('100.0')}*{pos}/greatest(count(user_feedback),1),1) AS feedback_pct FROM lg""",
        "judge_score_avg": f"""{_LOG}
SELECT round(avg(judge_relevance+judge_accuracy+judge_completeness)/{D('3.0')},2) AS score
FROM lg WHERE judge_relevance IS NOT NULL""",
        "feedback_pct": f"""{_LOG}
SELECT round({D('100.0')}*{pos}/NULLIF(count(user_feedback),0),1) AS pct
FROM lg WHERE user_feedback IS NOT NULL""",
        "query_volume_hourly": f"""{_LOG}
SELECT date_trunc('hour', timestamp) AS time, count(*) AS queries FROM lg GROUP BY 1 ORDER BY 1""",
        "latency_by_stage": f"""{_LOG}
SELECT stage, CAST(round(avg(ms)) AS INTEGER) AS ms FROM ({unpivot}) GROUP BY stage""",
        "recent_queries": f"""{_LOG}
SELECT timestamp, left(question, 80) AS question, judge_relevance, judge_accuracy,
       judge_completeness, total_ms FROM lg ORDER BY timestamp DESC, id DESC LIMIT 20""",
        "top_rewritten": f"""{_LOG}
SELECT tag_word, count(*) AS occurrences FROM (SELECT unnest(rewritten_queries) AS tag_word FROM lg)
GROUP BY tag_word ORDER BY occurrences DESC, tag_word LIMIT 20""",
        "feedback_latest": f"{_LOG} SELECT id, session_id, user_feedback FROM lg",
        "service_health": f"""{_LOG}
SELECT CASE WHEN bool_and(ok) THEN 'healthy' ELSE 'degraded' END AS status,
       count(*) AS n_services, count(*) FILTER (WHERE NOT ok) AS n_down
FROM (SELECT stage AS service, avg(ms) < 500 AS ok FROM ({unpivot}) GROUP BY stage)""",
    }


def _profiles() -> dict[str, str]:
    ntok = f"len({duck.tokens('answer_prose')})"
    meas = " UNION ALL ".join(
        f"SELECT '{k}' AS metric, CAST(CASE WHEN {v} IS NOT NULL THEN least({v}, {b}) END AS DOUBLE) AS x FROM clean"
        for k, v, b in (("question_score", "question_score", 200), ("answer_score", "answer_score", 100),
                        ("ans_len", ntok, 600)))
    w = f"((hi - lo) / {D('40.0')})"
    return {
        "tag_top20": f"""WITH {_CLEAN[:-1]}
SELECT tag, count(*) AS count FROM (SELECT unnest(tags_list) AS tag FROM clean)
GROUP BY tag ORDER BY count DESC, tag LIMIT 20""",
        "score_histogram": f"""WITH {_CLEAN}
m AS (SELECT * FROM ({meas}) WHERE x IS NOT NULL),
r AS (SELECT metric, min(x) AS lo, max(x) AS hi FROM m GROUP BY metric),
c AS (SELECT metric, CAST(CASE WHEN hi = lo THEN 0 ELSE
          least(floor((x - lo) * ({D('40.0')} / (hi - lo))), 39) END AS INTEGER) AS bin, count(*) AS n
      FROM m JOIN r USING (metric) GROUP BY ALL)
SELECT r.metric, g.bin, round(lo + g.bin * {w}, 6) AS bin_lo, round(lo + (g.bin + 1) * {w}, 6) AS bin_hi,
       coalesce(c.n, 0) AS count
FROM r CROSS JOIN (SELECT CAST(unnest(range(0, 40)) AS INTEGER) AS bin) g
LEFT JOIN c ON c.metric = r.metric AND c.bin = g.bin""",
        "length_describe": f"""WITH {_CLEAN} t AS (SELECT {ntok} AS n FROM clean)
SELECT round(CAST(count(n) AS DOUBLE), 1) AS count, round(avg(n), 1) AS mean, round(stddev_samp(n), 1) AS std,
       round(CAST(min(n) AS DOUBLE), 1) AS min, round(quantile_cont(n, 0.25), 1) AS p25,
       round(quantile_cont(n, 0.5), 1) AS p50, round(quantile_cont(n, 0.75), 1) AS p75,
       round(CAST(max(n) AS DOUBLE), 1) AS max FROM t""",
        "posts_per_year": f"""WITH {_CLEAN[:-1]}
SELECT CAST(year(TRY_CAST(creation_date AS DATE)) AS INTEGER) AS year, count(*) AS posts FROM clean
WHERE TRY_CAST(creation_date AS DATE) IS NOT NULL GROUP BY 1 ORDER BY 1""",
        "top_post": f"""WITH {_CLEAN[:-1]}
SELECT question_id, question_title, tags_list, question_score, substring(answer_prose, 1, 500) AS answer_head
FROM clean ORDER BY question_score DESC, seq LIMIT 1""",
    }


POSTS = f"""
SELECT CAST(conv_id*1000+turn AS VARCHAR) AS Id,
       CASE role WHEN 'user' THEN '1' WHEN 'assistant' THEN '2' ELSE '4' END AS PostTypeId,
       CASE WHEN role = 'user' THEN CAST(conv_id*1000+turn+1 AS VARCHAR) END AS AcceptedAnswerId,
       CAST((conv_id*7+turn)%20 AS VARCHAR) AS Score,
       CASE WHEN conv_id%3 <> 0 THEN concat('<python><t', CAST(conv_id%5 AS VARCHAR), '>') ELSE '<java>' END AS Tags,
       {duck.date_from('2019-07-01', '(conv_id*7)%900')} AS CreationDate,
       CASE WHEN conv_id%11 = 0 THEN '2024-01-01' END AS ClosedDate,
       {duck.first8('text')} AS Title, concat('<p>', text, '</p>') AS Body, conv_id*1000+turn AS seq
FROM conversations"""

_NUM = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def safe_int_sql(x: str) -> str:
    s = f"trim(CAST({x} AS VARCHAR))"
    d = f"TRY_CAST({s} AS DOUBLE)"
    return (f"coalesce(CASE WHEN regexp_full_match({s}, '{_NUM}') AND NOT isnan({d}) AND abs({d}) < 9223372036854775808 "
            f"THEN CAST(trunc({d}) AS BIGINT) END, 0)")


def _ingest() -> dict[str, str]:
    st = duck.strip
    keep_last = """
typed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY PostTypeId, Id ORDER BY seq DESC) AS rn
                         FROM posts WHERE PostTypeId IN ('1', '2')) WHERE rn = 1)"""
    html_code = (f"concat('<p>', coalesce(string_split(text, chr(10))[1], ''), '</p><pre><code>', "
                 f"coalesce(string_split(text, chr(10))[2], ''), '</code></pre><p>', "
                 f"array_to_string(list_slice(string_split(text, chr(10)), 3, 1073741824), chr(10)), '</p>')")
    k = "json_extract_string(props, '$.k')"
    rewrite_raw = (f"CASE event_type WHEN 'view' THEN concat('[\"view ', {k}, '\", \"  value ', CAST(value AS VARCHAR), ' \"]') "
                   f"WHEN 'click' THEN concat('```json' || chr(10) || '[\"click\", \"k', {k}, '\"]' || chr(10) || '```') "
                   f"WHEN 'purchase' THEN '[]' WHEN 'signup' THEN '[\"\", \"  \"]' ELSE concat('not json ', {k}) END")
    judge_raw = (f"CASE event_type WHEN 'view' THEN concat('{{\"relevance\": ', CAST(CAST({k} AS INTEGER) % 7 AS VARCHAR), "
                 f"', \"accuracy\": ', CAST(value AS VARCHAR), ', \"completeness\": 3, \"reasoning\": \"ok ', {k}, '\"}}') "
                 f"WHEN 'click' THEN concat('```json' || chr(10) || '{{\"relevance\": 4.7, \"accuracy\": \"3\", \"completeness\": ', "
                 f"CAST(CAST({k} AS INTEGER) % 9 - 2 AS VARCHAR), '}}' || chr(10) || '```') "
                 f"WHEN 'purchase' THEN '[1, 2]' WHEN 'signup' THEN 'oops' ELSE '{{\"relevance\": null}}' END")

    def fences(x):
        s1 = st(x)
        s2 = f"(CASE WHEN starts_with({s1}, '```json') THEN substring({s1}, 8) ELSE {s1} END)"
        s3 = f"(CASE WHEN starts_with({s2}, '```') THEN substring({s2}, 4) ELSE {s2} END)"
        s4 = f"(CASE WHEN ends_with({s3}, '```') THEN substring({s3}, 1, length({s3}) - 3) ELSE {s3} END)"
        return st(s4)

    def clamp(v):
        return (f"CASE WHEN {v} IS NOT NULL AND NOT isnan({v}) THEN "
                f"CAST(floor(greatest(CAST(1.0 AS DOUBLE), least(CAST(5.0 AS DOUBLE), {v}))) AS INTEGER) END")
    jv = "j"
    is_obj = f"coalesce(json_type({jv}) = 'OBJECT', false)"

    def num(key):
        return f"TRY_CAST(json_extract_string({jv}, '$.{key}') AS DOUBLE)"
    labels = "['Any', '2020+', '2022+', '2023+', '2024+', '2021']"
    presets = "MAP {'2020+': '2020-01-01', '2022+': '2022-01-01', '2023+': '2023-01-01', '2024+': '2024-01-01'}"
    return {
        "qa_pairs_join": f"""WITH posts AS ({POSTS}), {keep_last},
q AS (SELECT * FROM typed WHERE PostTypeId = '1'), a AS (SELECT * FROM typed WHERE PostTypeId = '2')
SELECT md5(q.Id) AS doc_id, q.Id AS question_id, coalesce(q.Title, '') AS question_title,
       coalesce(q.Body, '') AS question_body, {safe_int_sql('q.Score')} AS question_score,
       coalesce(q.Tags, '') AS tags, substring(coalesce(q.CreationDate, ''), 1, 10) AS creation_date,
       coalesce(a.Body, '') AS accepted_answer, {safe_int_sql('a.Score')} AS answer_score,
       concat('https://stackoverflow.com/q/', q.Id) AS question_url
FROM q JOIN a ON q.AcceptedAnswerId = a.Id
WHERE {safe_int_sql('q.Score')} >= 5 AND contains(coalesce(q.Tags, ''), '<python>')
  AND substring(coalesce(q.CreationDate, ''), 1, 10) >= '2020-01-01'
  AND q.AcceptedAnswerId IS NOT NULL AND q.AcceptedAnswerId <> '' AND {safe_int_sql('a.Score')} >= 3""",
        "posts_self_join_top": f"""WITH posts AS ({POSTS}),
ex AS (SELECT q.Id, q.Title, q.Body, q.Score, q.Tags, substring(q.CreationDate, 1, 10) AS CreationDate,
              a.Body AS AcceptedAnswerBody, a.Score AS AnswerScore, q.seq
       FROM posts q JOIN posts a ON q.AcceptedAnswerId = a.Id
       WHERE {safe_int_sql('q.Score')} >= 5 AND q.Tags LIKE '%<python>%' AND q.CreationDate >= '2020-01-01'
         AND q.ClosedDate IS NULL AND {safe_int_sql('a.Score')} >= 3
       ORDER BY {safe_int_sql('q.Score')} DESC, q.seq LIMIT 50000)
SELECT md5({st("coalesce(Id, '')")}) AS doc_id, {st("coalesce(Id, '')")} AS question_id,
       {st("coalesce(Title, '')")} AS question_title, {st("coalesce(Body, '')")} AS question_body,
       {safe_int_sql('Score')} AS question_score, {st("coalesce(Tags, '')")} AS tags,
       {st("coalesce(CreationDate, '')")} AS creation_date, {st("coalesce(AcceptedAnswerBody, '')")} AS accepted_answer,
       {safe_int_sql('AnswerScore')} AS answer_score, concat('https://stackoverflow.com/q/', {st("coalesce(Id, '')")}) AS question_url
FROM ex WHERE {st("coalesce(Id, '')")} <> ''""",
        "safe_int": f"""SELECT event_id, {safe_int_sql(k)} AS k_int, {safe_int_sql('value')} AS value_int,
       {safe_int_sql('event_type')} AS type_int FROM events""",
        "doc_ids": f"""SELECT question_id, md5(question_id) AS doc_id,
       regexp_replace(md5(question_id), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') AS point_id,
       concat('https://stackoverflow.com/q/', question_id) AS question_url, substring(creation_date, 1, 10) AS creation_day
FROM ({duck.CORPUS})""",
        "html_to_text": f"SELECT page_id, {duck.html_to_text('html')} AS text FROM pages",
        "code_blocks": f"""SELECT doc_id, {duck.html_to_text(duck.html_without_code('html'))} AS prose,
       {duck.html_code_blocks('html')} AS blocks FROM (SELECT doc_id, {html_code} AS html FROM documents)""",
        "clean_records": f"""SELECT question_id, answer_prose, answer_code_blocks, question_prose, tags_list, text_for_embedding
FROM ({duck.clean_select(duck.CORPUS)})""",
        "ingest_counts": f"""SELECT count(*) AS total, count(*) FILTER (WHERE keep) AS kept, count(*) FILTER (WHERE NOT keep) AS filtered
FROM (SELECT ({st("coalesce(accepted_answer, '')")} <> '' AND len({duck.tokens('answer_prose')}) >= 10) AS keep
      FROM ({duck.clean_select(duck.CORPUS, keep_filter=False)}))""",
        "parse_rewrites": f"""SELECT event_id, CASE WHEN arr IS NOT NULL AND len(arr) > 0
           THEN list_filter(list_transform(arr, lambda x: {st('x')}), lambda x: x IS NOT NULL AND x <> '')
           ELSE [concat(event_type, ' ', props)] END AS queries
FROM (SELECT event_id, event_type, props, CASE WHEN json_valid(r) AND json_type(r) = 'ARRAY'
             THEN CAST(json_extract_string(r, '$[*]') AS VARCHAR[]) END AS arr
      FROM (SELECT *, {fences(rewrite_raw)} AS r FROM events))""",
        "parse_judge": f"""SELECT event_id,
       CASE WHEN {is_obj} THEN {clamp(num('relevance'))} END AS relevance,
       CASE WHEN {is_obj} THEN {clamp(num('accuracy'))} END AS accuracy,
       CASE WHEN {is_obj} THEN {clamp(num('completeness'))} END AS completeness,
       CASE WHEN {is_obj} THEN json_extract_string(j, '$.reasoning') ELSE 'judge error' END AS reasoning
FROM (SELECT event_id, CASE WHEN json_valid(jr) THEN jr END AS j
      FROM (SELECT event_id, {fences(judge_raw)} AS jr FROM events))""",
        "validate_requests": f"""SELECT request_id, after_date,
       list_filter([CASE WHEN question IS NULL OR length(question) < 10 THEN 'question: too short' END,
                    CASE WHEN length(question) > 1000 THEN 'question: too long' END,
                    CASE WHEN min_vote_score < 0 OR min_vote_score > 500 THEN 'min_vote_score: out of range' END,
                    CASE WHEN after_date IS NOT NULL AND NOT regexp_matches(after_date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')
                         THEN 'after_date: bad format' END,
                    CASE WHEN top_k < 1 OR top_k > 20 THEN 'top_k: out of range' END], lambda x: x IS NOT NULL) AS errors,
       len(list_filter([CASE WHEN question IS NULL OR length(question) < 10 THEN 1 END,
                        CASE WHEN length(question) > 1000 THEN 1 END,
                        CASE WHEN min_vote_score < 0 OR min_vote_score > 500 THEN 1 END,
                        CASE WHEN after_date IS NOT NULL AND NOT regexp_matches(after_date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN 1 END,
                        CASE WHEN top_k < 1 OR top_k > 20 THEN 1 END], lambda x: x IS NOT NULL)) = 0 AS valid
FROM (SELECT item_id AS request_id, text AS question, CAST((item_id*37)%600 - 20 AS INTEGER) AS min_vote_score,
             coalesce({presets}[{labels}[item_id % 6 + 1]], CASE WHEN item_id % 6 = 5 THEN '2021' END) AS after_date,
             CAST(item_id % 25 AS INTEGER) AS top_k FROM benchmark)""",
    }


def _share(a: str, b: str) -> str:
    """|distinct(a) & distinct(b)| / |distinct(a)| (0 when a is empty)."""
    return (f"CASE WHEN len(list_distinct({a})) > 0 THEN CAST(len(list_intersect(list_distinct({a}), "
            f"list_distinct({b}))) AS DOUBLE) / CAST(len(list_distinct({a})) AS DOUBLE) ELSE 0.0 END")


def _answer_ctes() -> str:
    """CTEs src, ctx, a0, ans over ``qs`` (query_id, question, ...) and ``rr``: the default generator and judge."""
    rejoin = lambda x: f"array_to_string(list_slice({duck.tokens(x)}, 1, 300), ' ')"
    fenced = ("array_to_string(list_transform(list_slice(coalesce(answer_code_blocks, []), 1, 2), "
              "lambda c: concat('```' || chr(10), c, chr(10) || '```')), chr(10))")
    prose = rejoin("coalesce(answer_prose, '')")
    block = (f"concat('[', CAST(rerank_rank AS VARCHAR), '] ', coalesce(question_title, ''), chr(10), "
             f"{prose}, chr(10), {fenced}, chr(10) || 'URL: ', coalesce(question_url, ''))")
    lq = duck.tokens("lower(question)")
    la = duck.tokens("lower(answer)")
    return f"""src AS (SELECT r.query_id, r.rerank_rank, c.question_id, c.answer_prose, {block} AS block,
               concat(coalesce(c.question_title, ''), ' ', coalesce(c.answer_prose, '')) AS text
        FROM rr r JOIN clean c USING (seq)),
ctx AS (SELECT query_id, count(*) AS n_sources, string_agg(block, chr(10) || chr(10) ORDER BY rerank_rank) AS context,
               first(answer_prose ORDER BY rerank_rank) AS first_prose,
               list(question_id ORDER BY rerank_rank) AS source_ids, list(text ORDER BY rerank_rank) AS source_texts
        FROM src GROUP BY query_id),
a0 AS (SELECT qs.query_id, qs.question, ctx.n_sources, ctx.context, ctx.source_ids, ctx.source_texts,
              CASE WHEN coalesce(ctx.n_sources, 0) > 0 THEN coalesce(ctx.first_prose, '')
                   ELSE 'No relevant Stack Overflow answers found for this question.' END AS answer
       FROM qs LEFT JOIN ctx USING (query_id)),
ans AS (SELECT *, CAST(1 + floor(CAST(4.0 AS DOUBLE) * ({_share(lq, la)})) AS INTEGER) AS relevance,
               CASE WHEN coalesce(n_sources, 0) > 0 THEN 5 ELSE 1 END AS accuracy,
               CAST(1 + floor(CAST(4.0 AS DOUBLE) * least(CAST(1.0 AS DOUBLE), len({la}) / CAST(100.0 AS DOUBLE))) AS INTEGER) AS completeness
        FROM a0)"""


def _pipeline(questions: str) -> str:
    """CTEs through ``ans`` (query_id, question, answer, n_sources, context,
    source_ids, source_texts, relevance, accuracy, completeness) for a relation
    of (query_id, question), with the default rewriter, retriever, reranker,
    generator and judge."""
    subq = f"SELECT query_id, {duck.strip('question')} AS question FROM qs WHERE {duck.strip('question')} <> ''"
    return f"""WITH {_CLEAN} qs AS ({questions}), {duck.bm25_ctes(_BM_DOCS, subq)}, {_hybrid_lists(40, subq)},
pool AS ({duck.rrf_fused('SELECT * FROM hl', 40)}), {_rerank_ctes('pool', 5)},
{_answer_ctes()}"""


def _pipelines() -> dict[str, str]:
    gt_q = lambda n: (f"SELECT gt_rank AS query_id, question_title AS question, answer_prose AS accepted_answer "  # noqa: E731
                      f"FROM (SELECT row_number() OVER (ORDER BY question_score DESC, seq) AS gt_rank, * FROM "
                      f"(SELECT * FROM clean WHERE coalesce(question_score, 0) >= 50 ORDER BY question_score DESC, seq LIMIT {n}))")
    k = "CAST(('0x' || substr(md5(text), 1, 4)) AS INTEGER) % 4"
    prompt_head = "'Question: ' || question || chr(10) || chr(10) || '--- Stack Overflow Context ---' || chr(10)"
    prompt_tail = ("chr(10) || '--- End Context ---' || chr(10) || chr(10) || "
                   "'Write a concise, accurate answer. If multiple approaches exist, compare them briefly.' || chr(10) || "
                   "'End with a Sources section listing the question URLs.'")
    ctx_toks = f"flatten(list_transform(contexts, lambda c: {duck.tokens('lower(c)')}))"
    gt_toks = f"flatten(list_transform(ground_truths, lambda c: {duck.tokens('lower(c)')}))"
    return {
        "batch_complete": f"""SELECT item_id AS query_id,
       CASE WHEN {k} IN (0, 1) THEN concat('answer: ', array_to_string(list_slice({duck.tokens('text')}, 1, 5), ' ')) END AS completion,
       CASE {k} WHEN 2 THEN 'HTTP 401' WHEN 3 THEN 'failed after 3 attempts: HTTP 503' END AS error,
       CAST(CASE {k} WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 3 END AS INTEGER) AS attempts
FROM benchmark""",
        "title_similarity": f"""WITH {_CLEAN}
top3 AS ({duck.dense_ranked('SELECT seq, text_for_embedding FROM clean', duck.QUESTIONS, 3)}),
qb AS ({duck.hash_sparse(duck.QUESTIONS, 'query_id', 'question')}),
tb AS ({duck.hash_sparse('SELECT seq, question_title FROM clean', 'seq', 'question_title')}),
qn AS (SELECT query_id, sqrt(CAST(sum(cnt * cnt) AS DOUBLE)) AS n FROM qb GROUP BY query_id),
tn AS (SELECT seq, sqrt(CAST(sum(cnt * cnt) AS DOUBLE)) AS n FROM tb GROUP BY seq),
dots AS (SELECT t.query_id, t.seq, sum(qb.cnt * tb.cnt) AS dot FROM top3 t JOIN qb ON qb.query_id = t.query_id
         JOIN tb ON tb.seq = t.seq AND tb.bucket = qb.bucket GROUP BY t.query_id, t.seq)
SELECT t.query_id, CAST(t.rank AS INTEGER) AS rank, c.question_id,
       round(CASE WHEN qn.n * tn.n > 0 THEN CAST(coalesce(d.dot, 0) AS DOUBLE) / (qn.n * tn.n) ELSE 0.0 END, 6) AS sim
FROM top3 t LEFT JOIN dots d ON d.query_id = t.query_id AND d.seq = t.seq
LEFT JOIN qn ON qn.query_id = t.query_id LEFT JOIN tn ON tn.seq = t.seq JOIN clean c ON c.seq = t.seq""",
        "pipeline_answers": f"""{_pipeline(duck.QUESTIONS)}
SELECT query_id, answer, coalesce(source_ids, []) AS source_ids,
       CASE WHEN {duck.strip('question')} <> '' THEN [{duck.strip('question')}] ELSE [] END AS rewritten_queries,
       relevance, accuracy, completeness, 'overlap stub' AS reasoning FROM ans""",
        "pipeline_requests": f"""{_request_ctes()},
rk AS (SELECT rr.* FROM rr JOIN valid USING (query_id) WHERE rerank_rank <= top_k),
qs AS (SELECT query_id, question FROM valid), {_answer_ctes().replace('FROM rr r', 'FROM rk r')}
SELECT query_id, answer, coalesce(source_ids, []) AS source_ids, relevance, accuracy, completeness FROM ans""",
        "pipeline_sources": f"""{_pipeline(duck.QUESTIONS)}
SELECT r.query_id, CAST(r.rerank_rank AS INTEGER) AS rank, coalesce(c.doc_id, '') AS doc_id,
       coalesce(c.question_title, '') AS question_title, coalesce(c.question_url, '') AS question_url,
       coalesce(c.tags_list, []) AS tags, coalesce(c.question_score, 0) AS question_score,
       coalesce(CAST(p.rrf_score AS DOUBLE), 0.0) AS retrieval_score,
       coalesce(CAST(r.reranker_score AS DOUBLE), 0.0) AS reranker_score
FROM rr r JOIN clean c USING (seq) JOIN pool p ON p.query_id = r.query_id AND p.seq = r.seq""",
        "prompt_context": f"""{_pipeline(duck.QUESTIONS)}
SELECT query_id, CAST(coalesce(n_sources, 0) AS INTEGER) AS n_sources,
       {prompt_head} || coalesce(context, '') || {prompt_tail} AS prompt FROM ans""",
        "generation_eval": f"""{_pipeline(gt_q(100))}
SELECT round(avg(CAST(relevance AS DOUBLE)), 4) AS avg_relevance, round(avg(CAST(accuracy AS DOUBLE)), 4) AS avg_accuracy,
       round(avg(CAST(completeness AS DOUBLE)), 4) AS avg_completeness, CAST(NULL AS DOUBLE) AS avg_latency_ms,
       count(*) AS n_questions FROM ans""",
        "ragas_eval": f"""{_pipeline(gt_q(50))},
rows AS (SELECT a.question, a.answer, coalesce(a.source_texts, []) AS contexts, [q.accepted_answer] AS ground_truths
         FROM ans a JOIN qs q USING (query_id)),
rg AS (SELECT {_share(duck.tokens('lower(answer)'), ctx_toks)} AS faithfulness,
              {_share(duck.tokens('lower(question)'), duck.tokens('lower(answer)'))} AS answer_relevancy,
              CASE WHEN len(contexts) > 0 THEN CAST(len(list_filter(contexts, lambda c: len(list_intersect(
                   list_distinct({duck.tokens('lower(c)')}), list_distinct({gt_toks}))) > 0)) AS DOUBLE)
                   / CAST(len(contexts) AS DOUBLE) ELSE 0.0 END AS context_precision,
              {_share(gt_toks, ctx_toks)} AS context_recall FROM rows)
SELECT round(avg(faithfulness), 4) AS faithfulness, round(avg(answer_relevancy), 4) AS answer_relevancy,
       round(avg(context_precision), 4) AS context_precision, round(avg(context_recall), 4) AS context_recall,
       count(*) AS n_questions FROM rg""",
    }


def oracle_sql() -> dict[str, str]:
    out = {
        "bm25_topk": _bm25(10, "SELECT seq FROM clean"),
        "bm25_filtered": _bm25(10, f"SELECT seq FROM clean WHERE {FILTER_SQL}"),
    }
    out.update(_retrieval())
    out.update(_evaluation())
    out.update(_ingest())
    out.update(_pipelines())
    out.update(_logs())
    out.update(_profiles())
    # The streaming jobs must give the batch answers.
    out["stream_query_volume"] = out["query_volume_hourly"]
    out["stream_feedback"] = out["feedback_latest"]
    out["stream_clean"] = out["clean_records"]
    # Written out and read back through the sources and sinks.
    cut = f"ORDER BY {safe_int_sql('q.Score')} DESC, q.seq LIMIT 50000"
    out["csv_roundtrip"] = out["posts_self_join_top"].replace(cut, "")
    out["xml_roundtrip"] = out["qa_pairs_join"]
    out["index_roundtrip"] = out["bm25_topk"]
    out["gt_roundtrip"] = out["build_eval_set"]
    out["metrics_roundtrip"] = out["retrieval_eval"]
    out["log_roundtrip"] = out["log_metrics"]
    out["vectors_roundtrip"] = f"""WITH {_CLEAN[:-1]}
SELECT r.query_id, CAST(r.rank AS INTEGER) AS rank, c.doc_id, CAST(r.score AS DOUBLE) AS score
FROM ({duck.dense_ranked('SELECT seq, text_for_embedding FROM clean', duck.QUESTIONS, 10)}) r
JOIN clean c USING (seq)"""
    runs = ("SELECT seq, CASE WHEN coalesce(question_score, 0) >= 20 THEN text_for_embedding ELSE question_title END "
            "AS text_for_embedding FROM clean")
    out["vectors_upsert"] = f"""WITH {_CLEAN[:-1]}
SELECT r.query_id, CAST(r.rank AS INTEGER) AS rank,
       regexp_replace(c.doc_id, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') AS point_id,
       c.doc_id, c.question_title, c.tags_list, CAST(r.score AS DOUBLE) AS score
FROM ({duck.dense_ranked(runs, duck.QUESTIONS, 10)}) r JOIN clean c USING (seq)"""
    out["clean_sink"] = f"""WITH k AS ({out["clean_records"]}), n AS ({out["ingest_counts"]})
SELECT question_id, answer_prose, total, kept, filtered FROM k, n"""
    return out
