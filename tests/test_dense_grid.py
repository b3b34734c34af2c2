"""Dense search as a grid of query blocks and document blocks, against brute force."""

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.operators import dense


def _rows(rng, n, dim):
    return [(i, rng.integers(-3, 4, dim).astype(float).tolist()) for i in range(n)]


def _brute(docs, queries, k):
    out = {}
    for q, v in queries:
        scored = []
        for d, u in docs:
            u, v = np.array(u), np.array(v)
            norm = np.sqrt(u @ u) * np.sqrt(v @ v)
            cos = Decimal(repr(float(u @ v / norm))) if norm else Decimal(0)
            scored.append((-cos.quantize(Decimal("0.000001"), ROUND_HALF_UP), d))
        out[q] = [d for _, d in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("cells, bound", [(1 << 20, 64 << 20), (40, 64 << 20), (40, 0)])
def test_grid_is_brute_force(spark, monkeypatch, cells, bound):
    """One block, many blocks, and many blocks that meet in a shuffle."""
    monkeypatch.setattr(dense, "BROADCAST_MAX_BYTES", bound)
    rng = np.random.default_rng(5)
    docs, queries = _rows(rng, 137, 8), _rows(rng, 41, 8) + [(99, [0.0] * 8)]
    frames = [spark.createDataFrame(x, f"{k} long, embedding array<double>").repartition(4) for x, k in ((docs, "seq"), (queries, "query_id"))]
    search = dense.dense_search(*frames, top_k=7, block_cells=cells)
    plan = search._jdf.queryExecution().toString()
    assert ("NestedLoop" in plan or "Cartesian" in plan) is False
    got = {}
    for r in search.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.seq)
    assert got == _brute(docs, queries, 7)


def test_sparse_vectors_equal_dense_ones(spark):
    texts = spark.createDataFrame([(i, " ".join(f"w{i * j % 13}" for j in range(i % 7))) for i in range(60)], "seq long, t string")
    sparse = dense.hash_embed(texts, ["seq"], "t", dim=16)
    full = sparse.select("seq", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.coalesce(F.try_element_at(
        F.map_from_arrays("embedding.idx", "embedding.val"), i), F.lit(0.0))).alias("embedding"))
    ask = [x.withColumnRenamed("seq", "query_id") for x in (sparse, full)]
    a, b = (dense.dense_search(d, q, 5, block_cells=160).orderBy("query_id", "rank").collect() for d, q in zip((sparse, full), ask))
    assert a == b and len(a) > 200


def test_edges(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [])], "seq long, embedding array<double>")
    ask = spark.createDataFrame([(1, [1.0, 0.0]), (None, [0.0, 1.0]), (3, None)], "query_id long, embedding array<double>")
    got = {}
    for r in dense.dense_search(docs, ask, 2).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.seq, float(r.score)))
    assert got == {1: [(1, 1.0), (2, 0.0)], None: [(1, 0.0), (2, 0.0)], 3: [(1, 0.0), (2, 0.0)]}
    assert dense.dense_search(docs.limit(0), ask, 2).count() == 0
    assert dense.dense_search(docs, ask.limit(0), 2).count() == 0
    with pytest.raises(Exception, match="different lengths"):
        dense.dense_search(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], docs.schema).coalesce(1), ask, 2).collect()


def test_queries_never_reach_the_driver(spark, monkeypatch):
    """Planning a search of a million queries reads their number and width, no vector."""
    ask = spark.range(1_000_000).select(F.col("id").alias("query_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    docs = spark.range(5).select(F.col("id").alias("seq"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    real, seen = type(ask).collect, []

    def collect(frame):
        rows = real(frame)
        seen.extend(rows)
        return rows

    monkeypatch.setattr(type(ask), "toPandas", None)
    monkeypatch.setattr(type(ask), "collect", collect)
    search = dense.dense_search(docs, ask, 1)
    assert search.columns == ["query_id", "seq", "score", "rank"]
    assert [tuple(r)[:2] for r in seen] == [(1_000_000, 2)]
