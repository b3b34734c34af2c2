"""Vector table: runs merged on read, earlier versions readable, payload complete."""

from quillrank.sources.readers import read_vectors
from quillrank.sources.sinks import PAYLOAD, compact_vectors, upsert_vectors, vector_points


def _points(spark, rows):
    docs = spark.createDataFrame([r[:3] for r in rows], "seq long, doc_id string, question_id string")
    vecs = spark.createDataFrame([(r[0], r[3]) for r in rows], "seq long, embedding array<double>")
    return vector_points(docs, vecs)


def _held(df):
    return sorted((r.doc_id, r.seq, list(r.embedding)) for r in df.collect())


A, B, C = (c * 32 for c in "abc")


def test_runs_merge_and_versions_stay(spark, tmp_path):
    path = str(tmp_path / "v")
    upsert_vectors(_points(spark, [(1, A, "1", [1.0]), (2, B, "2", [2.0]), (3, A, "1", [3.0])]), path, 1)
    upsert_vectors(_points(spark, [(4, B, "2", [4.0]), (5, C, "5", [5.0])]), path, 2)
    assert _held(read_vectors(spark, path)) == [(A, 3, [3.0]), (B, 4, [4.0]), (C, 5, [5.0])]
    assert _held(read_vectors(spark, path, 1)) == [(A, 3, [3.0]), (B, 2, [2.0])]
    # a run that is repeated replaces itself
    upsert_vectors(_points(spark, [(4, B, "2", [4.5])]), path, 2)
    assert _held(read_vectors(spark, path)) == [(A, 3, [3.0]), (B, 4, [4.5])]
    compact_vectors(spark, path, str(tmp_path / "w"))
    assert _held(read_vectors(spark, str(tmp_path / "w"))) == [(A, 3, [3.0]), (B, 4, [4.5])]


def test_payload_has_defaults(spark):
    r = _points(spark, [(1, A, "1", [1.0])]).first()
    assert r.point_id == "aaaaaaaa-aaaa-aaaa-aaaa-aaaaaaaaaaaa"
    assert {c: r[c] for c in PAYLOAD} == {
        "doc_id": A, "question_id": "1", "question_title": "", "question_url": "", "answer_prose": "",
        "tags_list": [], "question_score": 0, "answer_score": 0, "creation_date": ""}


def test_missing_ids_keep_their_documents(spark, tmp_path):
    path = str(tmp_path / "v")
    upsert_vectors(_points(spark, [(1, None, "1", [1.0]), (2, None, "2", [2.0]), (2, None, "2", [2.0])]), path, 1)
    assert [v for _, _, v in _held(read_vectors(spark, path))] in ([[1.0], [2.0]], [[2.0], [1.0]])


def test_empty_run(spark, tmp_path):
    path = str(tmp_path / "v")
    upsert_vectors(_points(spark, [(1, A, "1", [1.0])]).where("false"), path, 1)
    assert read_vectors(spark, path).count() == 0


def test_runs_are_pruned(spark, tmp_path):
    path = str(tmp_path / "v")
    for v in (1, 2, 3):
        upsert_vectors(_points(spark, [(v, A, "1", [float(v)])]), path, v)
    plan = read_vectors(spark, path, 2)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters" in plan and "version" in plan
