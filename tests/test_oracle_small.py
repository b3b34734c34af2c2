"""Registered queries against their DuckDB oracle on the smallest tables."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E
from quillrank.sources.tables import TABLES

from conftest import SMALL

FAST = ["bm25_topk", "bm25_filtered", "bm25_zero_fill", "dense_topk", "rrf_fusion",
        "qa_pairs_join", "posts_self_join_top", "safe_int", "html_to_text", "code_blocks",
        "parse_rewrites", "parse_judge", "validate_requests", "log_metrics",
        "latency_by_stage", "top_rewritten", "feedback_latest", "score_histogram",
        "batch_complete", "build_eval_set"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if v.__class__.__name__ == "Decimal":
        return repr(round(float(v), 9))
    return repr(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    from quillrank.plans.catalog import QUERIES
    missing = set(QUERIES) - set(E.oracle_sql())
    assert not missing, missing


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _digest(df.columns, rows) == _digest(dcols, cur.fetchall())


def test_entry_smoke(spark):
    out = E.entry(spark)
    assert out.count() > 0
    assert out.columns == ["query_id", "rank", "doc_id", "question_id", "score"]
