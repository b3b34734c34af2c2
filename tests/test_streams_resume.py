"""Streams that stop and go on: results equal the batch forms, repeats and late rows are defined."""

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from quillrank.operators import logs
from quillrank.operators.clean import clean_pairs
from quillrank.sources import tables
from quillrank.streaming import logs_stream as ls


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _by_time(spark, n=3):
    """The events in ``n`` slices of time, as frames."""
    e = tables.table(spark, SMALL, "events")
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    step = (hi - lo) / n
    cuts = [lo + step * i for i in range(n)] + [hi + dt.timedelta(seconds=1)]
    return e, [e.where((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b))) for a, b in zip(cuts, cuts[1:])]


@pytest.mark.parametrize("mode", ["update", "append"])
def test_query_volume_resumes(spark, tmp_path, mode):
    e, parts = _by_time(spark)
    inp, out, cp = (str(tmp_path / d) for d in ("in", "out", "cp"))
    for i, p in enumerate(parts):  # every slice arrives, then the job runs and stops
        p.coalesce(1).write.mode("append").parquet(inp)
        ls.query_volume_job(tables.query_logs_from(ls.file_stream(spark, inp, e.schema)), out, cp, mode)
    want = _rows(logs.query_volume_hourly(tables.query_logs_from(e)))
    got = _rows(ls.read_query_volume(spark, out))
    if mode == "update":
        assert got == want
    else:  # closed hours only, each written once
        assert got == want[:len(got)] and len(got) >= len(want) - 3
        assert ls.read_batches(spark, out, ls.VOLUME_SCHEMA).count() == len(got)
    # nothing new: another run changes nothing
    ls.query_volume_job(tables.query_logs_from(ls.file_stream(spark, inp, e.schema)), out, cp, mode)
    assert _rows(ls.read_query_volume(spark, out)) == got


def test_repeated_batch_is_written_once(spark, tmp_path):
    e, parts = _by_time(spark, n=2)
    inp, out, cp = (str(tmp_path / d) for d in ("in", "out", "cp"))
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(inp)
        ls.feedback_job(tables.feedback_from(ls.file_stream(spark, inp, e.schema)), out, cp)
    before = _rows(ls.read_batches(spark, out, ls.FEEDBACK_SCHEMA))
    # the last batch was written, but its commit is lost: the stream repeats it
    for name in ("1", ".1.crc"):
        f = tmp_path / "cp" / "commits" / name
        if f.exists():
            f.unlink()
    ls.feedback_job(tables.feedback_from(ls.file_stream(spark, inp, e.schema)), out, cp)
    assert _rows(ls.read_batches(spark, out, ls.FEEDBACK_SCHEMA)) == before
    assert _rows(ls.read_feedback(spark, out)) == _rows(logs.last_feedback(tables.feedback_from(e)))


def test_late_feedback_counts(spark, tmp_path):
    inp, out, cp = (str(tmp_path / d) for d in ("in", "out", "cp"))
    schema = "session_id string, ts timestamp_ntz, seq bigint, feedback int"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inp)
        ls.feedback_job(ls.file_stream(spark, inp, schema), out, cp)

    day = dt.datetime(2024, 1, 1)
    arrive([("a", day + dt.timedelta(days=30), 5, 1), (None, day, 1, 1)])
    arrive([("a", day, 2, -1), ("b", day, 3, -1), ("b", day, 4, 1)])  # a month behind the first batch
    got = {r.session_id: (r.last_feedback, r.last_ts) for r in ls.read_feedback(spark, out).collect()}
    assert got == {"a": (1, day + dt.timedelta(days=30)), "b": (1, day), None: (1, day)}


def test_clean_drops_repeated_files(spark, tmp_path):
    corpus = tables.corpus(spark, SMALL).cache()
    inp, out, cp = (str(tmp_path / d) for d in ("in", "out", "cp"))
    corpus.where("seq % 2 = 0").coalesce(1).write.parquet(inp)
    ls.clean_job(ls.file_stream(spark, inp, corpus.schema), out, cp)
    part = next((tmp_path / "in").glob("part-*.parquet"))
    shutil.copy(part, tmp_path / "in" / "again.parquet")  # the same file once more
    corpus.where("seq % 2 = 1").coalesce(1).write.mode("append").parquet(inp)
    ls.clean_job(ls.file_stream(spark, inp, corpus.schema), out, cp)
    cols = ["question_id", "answer_prose", "text_for_embedding"]
    assert _rows(ls.read_clean(spark, out).select(cols)) == _rows(clean_pairs(corpus).select(cols))


def test_no_input_gives_an_empty_result(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    ls.feedback_job(ls.file_stream(spark, str(tmp_path / "in"), "session_id string, ts timestamp_ntz, seq bigint, feedback int"),
                    out, cp)
    assert ls.read_feedback(spark, out).count() == 0
