"""DuckDB spellings of the engine's column functions, for the oracle SQL.

The oracle is independent SQL text run by DuckDB on the same parquet tables;
these helpers only keep the long regular expressions in one place.  Patterns
are written for RE2 (DuckDB), which has no ``(?U)``: Unicode whitespace is an
explicit class equal to Java's ``(?U)\\s``.
"""

from __future__ import annotations

from html.entities import html5

WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda t: t <> '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def truncate(x: str, n: int | None) -> str:
    if n is None:
        return x
    return (f"(CASE WHEN len({tokens(x)}) > {n} "
            f"THEN array_to_string(list_slice({tokens(x)}, 1, {n}), ' ') ELSE {x} END)")


_NAMES = sorted(n[:-1] for n in html5 if n.endswith(";") and n not in ("amp;", "AMP;"))
_ENTITY_MAP = (f"MAP([{', '.join(q(n) for n in _NAMES)}], "
               f"[{', '.join(q(html5[n + ';']) for n in _NAMES)}])")


def decode_entities(x: str) -> str:
    out = (f"list_reduce(list_prepend({x}, list_distinct(regexp_extract_all({x}, "
           f"'&([A-Za-z][A-Za-z0-9]{{1,31}});', 1))), lambda acc, n: replace(acc, '&' || n || ';', "
           f"coalesce({_ENTITY_MAP}[n], '&' || n || ';')))")
    for pat, prefix, radix in ((r"&#([0-9]+);", "&#", 10),
                               (r"&#x([0-9a-fA-F]+);", "&#x", 16), (r"&#X([0-9a-fA-F]+);", "&#X", 16)):
        digits = "ltrim(d, '0')" if radix == 10 else "'0x' || ltrim(d, '0')"
        cp = f"(CASE WHEN length(ltrim(d, '0')) BETWEEN 1 AND 7 THEN TRY_CAST(({digits}) AS BIGINT) ELSE 0 END)"
        ch = (f"CASE WHEN {cp} > 0 AND {cp} <= 1114111 AND NOT ({cp} BETWEEN 55296 AND 57343) "
              f"THEN chr(CAST({cp} AS INTEGER)) ELSE chr(65533) END")
        out = (f"list_reduce(list_prepend({out}, list_distinct(regexp_extract_all({out}, "
               f"{q(pat)}, 1))), lambda acc, d: replace(acc, '{prefix}' || d || ';', {ch}))")
    out = f"regexp_replace({out}, '&(?:amp|AMP);', '&', 'g')"
    return f"(CASE WHEN instr({x}, '&') > 0 THEN {out} ELSE {x} END)"


def collapse_ws(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), '^ | $', '', 'g')"


TAG = r"""<[A-Za-z/!?][^>=]*(?:=\s*(?:"[^"]*"|'[^']*')?[^>=]*)*>"""


def html_to_text(x: str) -> str:
    s = f"coalesce({x}, '')"
    s = (f"regexp_replace({s}, '(?is)<!--.*?(?:-->|\\z)|<script\\b[^>]*(?:>.*?(?:</script\\s*>|\\z)|\\z)"
         f"|<style\\b[^>]*(?:>.*?(?:</style\\s*>|\\z)|\\z)', ' ', 'g')")
    s = f"regexp_replace({s}, {q(TAG)}, ' ', 'g')"
    return collapse_ws(decode_entities(s))


PRE = r"(?is)<pre\b[^>]*(?:>(.*?)(?:</pre\s*>|\z)|\z)"


def html_without_code(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '{PRE}', ' [CODE] ', 'g')"


def html_code_blocks(x: str) -> str:
    inner = f"regexp_replace(b, {q(TAG)}, '', 'g')"
    return (f"list_transform(regexp_extract_all(coalesce({x}, ''), '{PRE}', 1), "
            f"lambda b: {strip(decode_entities(inner))})")


def tags_to_array(x: str) -> str:
    return f"list_filter(string_split_regex(coalesce({x}, ''), '[<>]'), lambda t: {strip('t')} <> '')"


def first8(x: str) -> str:
    return f"array_to_string(list_slice({tokens(x)}, 1, 8), ' ')"


def date_from(base: str, days: str) -> str:
    return f"strftime(DATE '{base}' + CAST({days} AS INTEGER), '%Y-%m-%d')"


# --- adapters (FIXTURES.md part C) ------------------------------------------

CORPUS = f"""
SELECT md5(CAST(doc_id AS VARCHAR)) AS doc_id, CAST(doc_id AS VARCHAR) AS question_id,
       {first8('text')} AS question_title,
       concat('<p>', {first8('text')}, '</p>') AS question_body,
       CAST((doc_id*37)%97 AS INTEGER) AS question_score,
       concat('<', lang, '><', source, '>') AS tags,
       {date_from('2020-01-01', 'doc_id%1461')} AS creation_date,
       concat('<p>', text, '</p>') AS accepted_answer,
       CAST((doc_id*13)%41 AS INTEGER) AS answer_score,
       concat('https://example.org/q/', CAST(doc_id AS VARCHAR)) AS question_url,
       doc_id AS seq
FROM documents"""


def clean_select(src: str, max_answer_tokens: int | None = 512, max_body_tokens: int | None = 256,
                 max_embed_tokens: int | None = 512, keep_filter: bool = True) -> str:
    """qa_pairs -> qa_pairs_clean (P7-P11 + F6) over relation ``src``."""
    prose = truncate(html_to_text(html_without_code("accepted_answer")), max_answer_tokens)
    emb = truncate("concat('TITLE: ', coalesce(question_title, ''), ' | TAGS: ', "
                   "array_to_string(tags_list, ' '), ' | ANSWER: ', answer_prose)",
                   max_embed_tokens)
    keep = (f"{strip('coalesce(accepted_answer, ' + chr(39) + chr(39) + ')')} <> '' "
            f"AND len({tokens('answer_prose')}) >= 10")
    return f"""
SELECT *, {emb} AS text_for_embedding FROM (
  SELECT *, {prose} AS answer_prose,
         {html_code_blocks('accepted_answer')} AS answer_code_blocks,
         {truncate(html_to_text('question_body'), max_body_tokens)} AS question_prose,
         {tags_to_array('tags')} AS tags_list
  FROM ({src})
) {'WHERE ' + keep if keep_filter else ''}"""


def clean_corpus(max_answer_tokens: int | None = None, max_embed_tokens: int | None = None) -> str:
    """The registered queries' corpus: whole answers and whole embedding text."""
    return clean_select(CORPUS, max_answer_tokens=max_answer_tokens, max_body_tokens=None,
                        max_embed_tokens=max_embed_tokens)


QUESTIONS = "SELECT item_id AS query_id, text AS question FROM benchmark"


def bm25_ctes(docs: str, queries: str, key: str = "query_id", text: str = "question") -> str:
    """CTEs ``bm_docs, postings, sizes, term_stats, stats, qterms, contrib``.

    ``docs`` is a relation with (seq, question_title, answer_prose); ``queries``
    has (``key``..., ``text``).  ``key`` may be a comma list.
    """
    return f"""
bm_docs AS ({docs}),
bm_toks AS (SELECT seq, {tokens("lower(concat(coalesce(question_title, ''), ' ', coalesce(answer_prose, '')))")} AS toks FROM bm_docs),
sizes AS (SELECT count(*) AS n_docs, CAST(sum(len(toks)) AS BIGINT) AS sum_dl FROM bm_toks),
postings AS (SELECT seq, dl, term, count(*) AS tf
             FROM (SELECT seq, len(toks) AS dl, unnest(toks) AS term FROM bm_toks) GROUP BY seq, dl, term),
term_stats AS (SELECT term, n_t, ln(CAST(n_docs - n_t AS DOUBLE) + CAST(0.5 AS DOUBLE))
                                 - ln(CAST(n_t AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS raw_idf
               FROM (SELECT term, count(*) AS n_t FROM postings GROUP BY term), sizes),
stats AS (SELECT n_docs, sum_dl, CAST(sum_dl AS DOUBLE) / CAST(n_docs AS DOUBLE) AS avgdl,
                 (SELECT CAST(sum(CAST(raw_idf AS DECIMAL(30,12))) AS DOUBLE) / CAST(count(*) AS DOUBLE)
                  FROM term_stats) AS mean_idf FROM sizes),
qterms AS (SELECT {key}, term, count(*) AS qtf
           FROM (SELECT {key}, unnest({tokens(f'lower({text})')}) AS term FROM ({queries}))
           GROUP BY {key}, term),
contrib AS (
  SELECT {', '.join('qt.' + k.strip() for k in key.split(','))}, p.seq,
         CAST(floor(
           (CASE WHEN ts.raw_idf < 0 THEN CAST(0.25 AS DOUBLE) * s.mean_idf ELSE ts.raw_idf END)
           * ((CAST(p.tf AS DOUBLE) * CAST(2.5 AS DOUBLE))
              / (CAST(p.tf AS DOUBLE) + CAST(1.5 AS DOUBLE) * ((CAST(1.0 AS DOUBLE) - CAST(0.75 AS DOUBLE))
                 + (CAST(0.75 AS DOUBLE) * CAST(p.dl AS DOUBLE)) / s.avgdl)))
           * CAST(1e9 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) * qt.qtf AS c
  FROM qterms qt JOIN term_stats ts ON qt.term = ts.term
  JOIN postings p ON p.term = qt.term, stats s)"""


#: A batch of requests with parameters of their own, checked and with defaults filled in.
REQUESTS = """
SELECT *, list_filter([CASE WHEN question IS NULL OR length(question) < 10 THEN 'question: too short' END,
                       CASE WHEN length(question) > 1000 THEN 'question: too long' END,
                       CASE WHEN min_vote_score < 0 OR min_vote_score > 500 THEN 'min_vote_score: out of range' END,
                       CASE WHEN NOT regexp_matches(after_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 'after_date: bad format' END,
                       CASE WHEN top_k < 1 OR top_k > 20 THEN 'top_k: out of range' END], lambda x: x IS NOT NULL) AS errors
FROM (SELECT item_id AS query_id, text AS question,
             coalesce(CASE WHEN item_id % 5 <> 0 THEN (item_id % 7) * 15 WHEN item_id % 10 = 0 THEN 900 END, 5) AS min_vote_score,
             CASE item_id % 3 WHEN 0 THEN ['en', 'de'] WHEN 1 THEN [concat('src', CAST(item_id % 20 AS VARCHAR))] ELSE [] END AS tags,
             CASE WHEN item_id % 13 = 0 THEN 'June 2021' WHEN item_id % 4 = 0 THEN '2021-06-01'
                  WHEN item_id % 4 = 1 THEN '2023-12-20' END AS after_date,
             coalesce(CASE WHEN item_id % 6 <> 0 THEN 1 + item_id % 22 END, 5) AS top_k FROM benchmark)"""


def bm25_ranked(allowed: str, queries: str, top_k: int, key: str = "query_id") -> str:
    """SELECT giving (key..., seq, score DOUBLE (6 places), rank) after fill + cut.

    Needs the ``contrib`` CTE.  ``allowed`` is a relation of allowed ``seq``.
    """
    keys = [k.strip() for k in key.split(",")]
    kq = ", ".join(f"q.{k}" for k in keys)
    kk = ", ".join(keys)
    return f"""
SELECT {kk}, seq, score, rank FROM (
  SELECT {kk}, seq, score,
         row_number() OVER (PARTITION BY {kk} ORDER BY score DESC, seq ASC) AS rank
  FROM (
    SELECT {kk}, seq, floor(CAST(sum(c) + 500 AS DOUBLE) / CAST(1000 AS DOUBLE)) / CAST(1e6 AS DOUBLE) AS score
    FROM (
      SELECT {kk}, seq, c FROM contrib
      UNION ALL
      SELECT {kq}, f.seq, CAST(0 AS BIGINT) AS c
      FROM (SELECT DISTINCT {kk} FROM ({queries})) q,
           (SELECT seq FROM ({allowed}) ORDER BY seq LIMIT {top_k}) f
    ) GROUP BY {kk}, seq
  ) WHERE seq IN (SELECT seq FROM ({allowed}))
) WHERE rank <= {top_k}"""


# --- query log (FIXTURES.md part C) -----------------------------------------

_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

QUERY_LOGS = f"""
SELECT event_id AS id, concat('u', CAST(user_id AS VARCHAR)) AS session_id, ts AS timestamp,
       concat(event_type, ' ', props) AS question,
       CASE WHEN event_id%10=0 THEN NULL ELSE CAST(1+event_id%5 AS INTEGER) END AS judge_relevance,
       CAST(1+(event_id // 5)%5 AS INTEGER) AS judge_accuracy,
       1 + {_K} % 5 AS judge_completeness,
       CAST(floor(value) AS INTEGER) AS rewrite_ms, CAST(floor(value*2) AS INTEGER) AS retrieval_ms,
       CAST(floor(value*3) AS INTEGER) AS reranker_ms, CAST(floor(value*10) AS INTEGER) AS generation_ms,
       CAST(floor(value*5) AS INTEGER) AS judge_ms,
       CAST(floor(value)+floor(value*2)+floor(value*3)+floor(value*10)+floor(value*5) AS INTEGER) AS total_ms,
       [event_type, concat(event_type, '-', CAST({_K} % 7 AS VARCHAR))] AS rewritten_queries
FROM events WHERE event_type IN ('view','click','purchase')"""

FEEDBACK = """
SELECT concat('u', CAST(user_id AS VARCHAR)) AS session_id, ts, event_id AS seq,
       CASE event_type WHEN 'signup' THEN 1 ELSE -1 END AS feedback
FROM events WHERE event_type IN ('signup','error')"""

LOG_TABLE = f"""
SELECT l.*, CAST(CASE WHEN f.last_ts >= l.timestamp THEN f.last_feedback END AS INTEGER) AS user_feedback
FROM ({QUERY_LOGS}) l LEFT JOIN (
  SELECT session_id, feedback AS last_feedback, ts AS last_ts FROM (
    SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, seq DESC) AS rn
    FROM ({FEEDBACK})) WHERE rn = 1) f USING (session_id)"""

STAGES = ["rewrite", "retrieval", "reranker", "generation", "judge"]


# --- dense (default embedder) -------------------------------------------------

def hash_sparse(src: str, key: str, text: str) -> str:
    """(key, bucket, cnt) of the hashed bag of words of ``text`` over ``src``."""
    b = "CAST(('0x' || substr(md5(t), 1, 6)) AS INTEGER) % 384"
    return (f"SELECT {key}, bucket, CAST(count(*) AS INTEGER) AS cnt FROM ("
            f"SELECT {key}, {b} AS bucket FROM (SELECT {key}, unnest({tokens(f'lower({text})')}) AS t "
            f"FROM ({src}))) GROUP BY {key}, bucket")


def dense_ranked(docs: str, queries: str, top_k: int, qkey: str = "query_id",
                 qtext: str = "question", dtext: str = "text_for_embedding") -> str:
    """(query_id, seq, score DECIMAL(18,6), rank) by cosine of hashed vectors,
    with the zero-score fill (docs sharing no bucket) in position order."""
    return f"""
SELECT {qkey}, seq, score, rank FROM (
  SELECT {qkey}, seq, score, row_number() OVER (PARTITION BY {qkey} ORDER BY score DESC, seq) AS rank
  FROM (
    SELECT {qkey}, seq, CAST(max(cos) AS DECIMAL(18,6)) AS score FROM (
      SELECT q.{qkey}, d.seq, CASE WHEN dn.n * qn.n > 0 THEN CAST(d.dot AS DOUBLE) / (dn.n * qn.n) ELSE 0 END AS cos
      FROM (SELECT q.{qkey}, d.seq, sum(q.cnt * d.cnt) AS dot
            FROM ({hash_sparse(queries, qkey, qtext)}) q JOIN ({hash_sparse(docs, 'seq', dtext)}) d USING (bucket)
            GROUP BY q.{qkey}, d.seq) d
      JOIN (SELECT seq, sqrt(CAST(sum(cnt * cnt) AS DOUBLE)) AS n FROM ({hash_sparse(docs, 'seq', dtext)}) GROUP BY seq) dn USING (seq)
      JOIN (SELECT {qkey}, sqrt(CAST(sum(cnt * cnt) AS DOUBLE)) AS n FROM ({hash_sparse(queries, qkey, qtext)}) GROUP BY {qkey}) qn USING ({qkey})
      JOIN (SELECT {qkey} FROM ({queries})) q USING ({qkey})
      UNION ALL
      SELECT q.{qkey}, f.seq, 0.0 AS cos FROM (SELECT DISTINCT {qkey} FROM ({queries})) q,
             (SELECT seq FROM ({docs}) ORDER BY seq LIMIT {top_k}) f
    ) GROUP BY {qkey}, seq
  )
) WHERE rank <= {top_k}"""


def rrf_fused(lists: str, top_n: int | None = None) -> str:
    """RRF over a relation (query_id, list_no, rank, seq): fused rows with
    rrf_score DECIMAL, first_list, first_rank, fused_rank."""
    cut = f"WHERE fused_rank <= {top_n}" if top_n else ""
    return f"""
SELECT * FROM (
  SELECT query_id, seq, rrf_score, first_list, first_rank,
         row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, first_list, first_rank) AS fused_rank
  FROM (
    SELECT query_id, seq,
           sum(CAST(CAST(1.0 AS DOUBLE) / (CAST(60.0 AS DOUBLE) + CAST(rank AS DOUBLE)) AS DECIMAL(28,15))) AS rrf_score,
           min(list_no * 1000000 + rank) // 1000000 AS first_list,
           min(list_no * 1000000 + rank) % 1000000 AS first_rank
    FROM ({lists}) GROUP BY query_id, seq)
) {cut}"""
