"""Steps that all searches share: texts are read in few passes, and an index moves values a document, not a token."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillrank.functions.html import collapse_ws, single_spaces
from quillrank.operators import dense, index
from quillrank.operators.bm25 import bm25_search
from quillrank.operators.clean import clean_pairs
from quillrank.operators.counting import token_text

CLEAN = "seq long, question_title string, answer_prose string, question_score int, tags_list array<string>, creation_date string"
ODD = ["", " ", "  ", "a", " a", "a ", "a b", "a  b", "a\tb", "a \tb", "a\t b", "\t", "\n\n a b  c 　", "a\x1cb", "\u0085x",
       "no break", "Aİ  B\nC", "tail \r\n", None]


def test_white_space_runs_become_one_space(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string").orderBy("i")
    space = "[\t-\r \x85\xa0  -     　]+"
    got = df.select("t", single_spaces("t").alias("s"), collapse_ws("t").alias("c"),
                    F.array_remove(F.split(token_text(F.col("t")), " "), "").alias("toks"),
                    F.array_remove(F.split(F.lower("t"), r"(?U)\s+"), "").alias("want")).collect()
    for r in got:
        want = None if r.t is None else re.sub(space, " ", r.t)
        assert (r.s, r.c) == (want, want if want is None else want.strip(" ")), repr(r.t)
        assert r.toks == r.want


def test_one_string_a_document_is_stored(spark):
    rows = [(1, "T", "a b a", 1, None, None), (2, None, None, 1, None, None), (3, "", "  ", 2, ["x"], None), (None, None, "c A", 3, None, None)]
    found = index.build_index(spark.createDataFrame(rows, CLEAN))
    assert dict(found.compact.dtypes) == {"seq": "bigint", "terms": "string", "counts": "binary", "dl": "int",
                                          "attrs": dict(found.doc_terms.dtypes)["attrs"]}
    assert sorted(map(tuple, found.postings.select("seq", "term", "tf", "dl").collect()), key=str) == sorted(
        [(1, "a", 2, 4), (1, "b", 1, 4), (1, "t", 1, 4), (None, "a", 1, 2), (None, "c", 1, 2)], key=str)
    assert {r.seq: (len(r.terms), r.attrs[0].tags_list) for r in found.doc_terms.collect()} == {
        1: (3, None), 2: (0, None), 3: (0, ["x"]), None: (2, None)}
    assert {r.term: r.n_t for r in found.term_stats.collect()} == {"a": 2, "b": 1, "c": 1, "t": 1}
    assert {r.seq: r.dl for r in found.docs.collect()} == {1: 4, 2: 0, 3: 0, None: 0}


def test_an_index_of_empty_texts(spark):
    found = index.build_index(spark.createDataFrame([(1, None, None, 1, None, None)], CLEAN))
    assert found.term_stats.count() == 0 and found.postings.count() == 0
    ask = spark.createDataFrame([(1, "a")], "query_id long, question string")
    assert [(r.seq, r.score) for r in bm25_search(found, ask, 3).collect()] == [(1, 0.0)]


def test_term_counts_are_added_up_in_the_task(spark, monkeypatch):
    docs = spark.createDataFrame([(i, None, f"all w{i % 5} own{i}", 1, None, None) for i in range(50)], CLEAN).coalesce(1)
    text = F.col("answer_prose")
    rows = index.compact_terms(docs, text).where("held is not null").select(F.inline("held")).collect()
    assert len(rows) == 56   # one row a term
    assert {r.term: r.n for r in rows} == {r.term: r.n_t for r in index.term_counts(index.document_terms(docs, text)).collect()}
    # where more terms than fit come, they go on in parts that add up to the same
    monkeypatch.setattr(index, "COUNTED_TERMS", 6)
    held, parts = index._TermCounts(), []
    for i in range(20):
        if held.add(pa.array(["all", f"w{i % 3}", f"own{i}"]), np.array([2, 1, 1])):
            parts += held.take().to_pylist()
    parts += held.take().to_pylist()
    sums = Counter()
    for p in parts:
        sums[p["term"]] += p["n"]
    assert held.take() is None and len(parts) > 24 and sums["all"] == 40 and sums["w0"] == 7 and len(sums) == 24


@pytest.mark.parametrize("dim", [384, 1 << 20])
def test_embedding_equals_the_column_form(spark, dim):
    texts = [(i, t) for i, t in enumerate([*ODD, "ü b ü", "x" * 70 + " b"])]
    df = spark.createDataFrame(texts, "i int, t string")
    want = {(r.i, r.bucket): float(r.cnt) for r in dense.hash_buckets(df, ["i"], "t", dim).collect()}
    got = {(r.i, b): v for r in dense.hash_embed(df, ["i"], "t", dim).collect() for b, v in zip(r.embedding.idx, r.embedding.val)}
    assert got == want and want


def test_answers_with_and_without_blocks(spark):
    html = ["<p>one two</p>", "<p>a<PRE><code>x &lt; 1</code></PRE>b</p>", "a<!-- c -->b", "<Script>x</script>y", "<STYLE>x</style>z", "<pre", None, "<p>1 < 2</p>"]
    words = " 1 2 3 4 5 6 7 8 9 10"
    pairs = spark.createDataFrame([(h and h + words, None, "t", "<a>") for h in html], "accepted_answer string, question_body string, question_title string, tags string")
    got = {r.accepted_answer: (r.answer_prose, r.answer_code_blocks) for r in clean_pairs(pairs).collect()}
    assert got == {h + words: v for h, v in {
        html[0]: ("one two" + words, []), html[1]: ("a [CODE] b" + words, ["x < 1"]), html[2]: ("a b" + words, []),
        html[3]: ("y" + words, []), html[4]: ("z" + words, []), html[7]: ("1 < 2" + words, [])}.items()}
