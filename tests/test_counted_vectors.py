"""rrf_contributions, retrieval_eval and the others that search both ways: a document's tokens are counted once for index and vector."""

from hashlib import md5

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillrank.functions.html import plain_spaces
from quillrank.operators import bm25, dense, index
from quillrank.operators.counting import token_counts
from quillrank.plans import retrieval

CLEAN = "seq long, question_title string, answer_prose string, question_score int, tags_list array<string>, creation_date string"
ROWS = [(1, "A b", "a b B title: |", 9, ["en", "A"], "2021-01-01"), (2, None, "x" * 300 + " éé y", 9, [], None),
        (3, "t", None, 9, ["en"], None), (4, "t", "u", 9, None, None), (5, "t", "low score", 1, ["en"], None), (6, "", "  ", 9, ["a b"], None),
        (None, "t", "no place", 9, ["en"], None)]


def _dense(df):
    rows = df.select("seq", "embedding").toArrow().combine_chunks()
    if not rows.num_rows:
        return {}
    found = rows.column("embedding")
    found = pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found
    return dict(zip(rows.column("seq").to_pylist(), map(tuple, dense.to_matrix(found).tolist())))


@pytest.mark.parametrize("cells", [1, 1 << 20])
def test_the_index_counts_the_vectors_of_hash_embed(spark, monkeypatch, cells):
    monkeypatch.setattr(dense, "COUNTED_CELLS", cells)
    clean = spark.createDataFrame(ROWS, CLEAN)
    got, want = _dense(retrieval.index_with_vectors(clean).vectors), _dense(retrieval.corpus_vectors(clean))
    assert got == want and set(want) == {1, 2, 5, 6, None}


def test_both_legs_read_the_texts_once(spark, monkeypatch):
    docs = [(i, f"t{i}", " ".join(f"w{i * j % 11}" for j in range(1, 9)), i % 12, ["en"], "2021-01-01", f"d{i}") for i in range(60)]
    clean = spark.createDataFrame(docs, CLEAN + ", doc_id string")
    ask = spark.createDataFrame([(1, "w3 w4"), (2, "w9 t7 w1")], "query_id long, question string")
    want = retrieval.hybrid_lists(index.build_index(clean), clean, ask, 5).collect()
    monkeypatch.setattr(retrieval, "corpus_vectors", None)
    assert sorted(retrieval.hybrid_lists(retrieval.index_with_vectors(clean), clean, ask, 5).collect()) == sorted(want)
    assert len(want) == 20


def test_repeated_positions_are_embedded_apart(spark):
    clean = spark.createDataFrame([*ROWS, ROWS[0]], CLEAN)
    assert retrieval.index_with_vectors(clean).vectors is None


def test_tokens_are_hashed_in_batches(monkeypatch):
    monkeypatch.setattr(dense, "HASHED_TOKENS", 7)
    monkeypatch.setattr(dense, "md5", lambda data: md5(data) if len(data) > 55 else pytest.fail("one call a token"))
    words = ["", *("a" * n for n in range(1, 131)), *("é€" * n for n in range(1, 20))]
    want = [int(md5(w.encode()).hexdigest()[:6], 16) % 384 for w in words]
    assert dense._buckets(pa.array(words), 384).tolist() == [-1, *want[1:]]
    assert dense._buckets(pa.array(words).slice(50, 20), 384).tolist() == want[50:70]
    assert len(dense._buckets(pa.array([], pa.string()), 384)) == 0


def test_blocks_keep_compact_rows_compact(spark):
    docs = spark.createDataFrame([(i, None, " ".join(f"w{i}x{j}" for j in range(50)), 1, None, None) for i in range(40)] + [(40, "", "", 1, None, None)], CLEAN)
    found = index.build_index(docs.coalesce(1))
    size = lambda df: sum(len(r.docs) for r in df.mapInArrow(bm25._document_blocks, "docs binary").collect())
    listed = found.doc_terms.select("seq", "terms", "tfs", "dls")
    assert size(found.compact.select("seq", "terms", "counts", "dl")) < 0.7 * size(listed)
    ask = spark.createDataFrame([(i, f"w{i}x1 w{i + 1}x49 w3x3") for i in range(5)], "query_id long, question string")
    lists = [sorted(bm25.match_scores(found, ask, ["query_id"], "question", 9, d).collect()) for d in (found.compact, listed)]
    assert lists[0] == lists[1] and len(lists[0]) > 9


def test_counts_of_one_run_are_not_merged_again():
    held = index._TermCounts()
    words = pa.array(["a", "b"])
    held.add(words, np.array([1, 2]))
    held._merge()
    assert held.held[0][0] is words
    held.add(pa.array(["b", "c"]), np.array([5, 6]))
    assert {p["term"]: p["n"] for p in held.take().to_pylist()} == {"a": 1, "b": 7, "c": 6}


def test_pairs_are_counted_in_either_size():
    lists = pa.array([["b", "a", "b", ""], None, [], ["a"]], pa.list_(pa.string()))
    words, row, code, n = token_counts(lists)
    assert [(int(r), words[int(c)].as_py(), int(k)) for r, c, k in zip(row, code, n)] == [(0, "b", 2), (0, "a", 1), (3, "a", 1)]
    assert row.dtype == code.dtype == np.int64


def test_white_space_is_found_by_what_it_begins_with(spark):
    texts = [f"é{chr(c)}x" for c in (9, 10, 13, 32, 0x84, 0x85, 0xa0, 0xa1, 0x1680, *range(0x1fff, 0x2061), 0x3000, 0x3001)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select(
            "t", plain_spaces("t").alias("got"), F.regexp_replace("t", r"(?U)\s", " ").alias("want")).collect():
        assert r.got == r.want, repr(r.t)
