"""Steps of every search over the corpus that took patterns, or cells of no use, for what plainer work gives."""

import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillrank.functions.html import BLOCK_RE, TAG_RE, has_blocks, replace_tags
from quillrank.functions.text import WS
from quillrank.operators import bm25
from quillrank.sources import tables

TAGGED = ["<p>plain text</p>", "<p></p>", "<p>", "</p>", "<p></p", "<p>a</p><p>b</p>", "<p>a <b>c</b></p>", "</<p>p>", "<</p>p>", "<p>a > b</p>",
          "<p>a <pre>b</p>", "<P>x</P>", "<p>x<!-- y</p>", "<p>é </p>", "a < b", "", None]


@pytest.mark.parametrize("by", [" ", ""])
def test_paragraphs_are_read_as_by_the_patterns(spark, by):
    df = spark.createDataFrame([(t,) for t in TAGGED], "t string")
    for r in df.select("t", replace_tags("t", by).alias("got"), F.regexp_replace("t", TAG_RE, by).alias("want"),
                       has_blocks("t").alias("b"), F.coalesce("t", F.lit("")).rlike(BLOCK_RE).alias("wb")).collect():
        assert (r.got, r.b) == (r.want, r.wb), repr(r.t)


def test_a_title_reads_the_beginning_of_a_text(spark):
    df = spark.range(0, 24, 1, 1).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit(" wordé"), 100_000)).alias("t")).cache()
    df.count()

    def seconds(col):
        found = []
        for _ in range(2):
            start = time.time()
            assert df.select(F.length(col).alias("n")).agg(F.max("n")).first()[0] == 2 + 7 * 6
            found.append(time.time() - start)
        return min(found)

    whole = F.array_join(F.slice(F.array_remove(F.split("t", WS, 10), ""), 1, 8), " ")
    assert seconds(tables._first8(F.col("t"))) < 0.6 * seconds(whole)


@pytest.mark.parametrize("idf", [2.5, -3.0, 1e7])   # the last one's sums are beyond what doubles hold exactly
@pytest.mark.parametrize("step", [1, 1 << 18])
def test_only_queries_with_a_term_are_scored_for_it(monkeypatch, idf, step):
    monkeypatch.setattr(bm25, "STEP_CELLS", step)
    asked = [["a", "b", "a"], [], ["c"], ["b", "zz"]]
    held = [["a", "b", "x"], [], ["c", "a"], ["x"]]
    term = pa.struct([("term", pa.string()), ("qtf", pa.int64()), ("idf", pa.float64()), ("avgdl", pa.float64())])
    lists = [[{"term": t, "qtf": n, "idf": idf, "avgdl": 2.0} for t, n in Counter(q).items()] for q in asked]
    queries = bm25._Queries(pa.table({"terms": pa.array(lists, pa.list_(term)), "params": pa.array([[{"_": 0}]] * 4)}))
    docs = pa.table({"terms": pa.array(held, pa.list_(pa.string())), "tfs": pa.array([[i + 1 for i, _ in enumerate(d)] for d in held], pa.list_(pa.int32())),
                     "dls": pa.array([[len(d)] * len(d) for d in held], pa.list_(pa.int32()))})
    weight = lambda tf, dl: int(np.floor(bm25.contribution(idf, float(tf), float(dl), 2.0) * bm25.NANO + 0.5))
    nano, hit = bm25._scores(docs, queries)
    assert nano.tolist() == [[sum(weight(i + 1, len(d)) * q.count(t) for i, t in enumerate(d)) for q in asked] for d in held]
    assert hit.tolist() == [[bool(set(d) & set(q)) for q in asked] for d in held]
    place, query, qtf = queries.holders(np.array([queries.terms.to_pylist().index(t) for t in ("b", "a")]))
    assert list(zip(place.tolist(), query.tolist(), qtf.tolist())) == [(0, 0, 1), (0, 3, 1), (1, 0, 2)]
