"""Structured Streaming forms of the log and ingest jobs.

A job is given its input stream, an output folder and a checkpoint folder; run
again with the same two it goes on where it stopped.  It takes what has
arrived (``availableNow``) and ends.  Micro-batch N is written to
``batch_id=N`` of the output and replaces that folder, so a batch that is
repeated after a failure is there once.  ``read_*`` gives the job's result so
far; a job that has seen no input has an empty result.

* X1 hourly query volume: event-time windows whose state goes when the
  watermark has passed them.  ``update`` writes every changed hour, the last
  version of which counts; ``append`` writes an hour once, when it is closed.
  A row that is older than the watermark when it arrives is not counted.
* X2 feedback: each micro-batch leaves the last feedback of its sessions, and
  reading merges these.  The last of the lasts is the last, so no state is
  kept, feedback may come at any time after its query, and a session with a
  third of all rows costs a row per task.
* X3 incremental cleaning: a record with the same content as one that arrived
  within ``within`` before it adds no row.  Time is the time of arrival, so
  old records of a new file are never late.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.operators.clean import clean_pairs
from quillrank.operators.logs import last_feedback
from quillrank.session import ensure_checkpoint_dir
from quillrank.sources import tables

VOLUME_SCHEMA = "time timestamp_ntz, queries bigint"
FEEDBACK_SCHEMA = "session_id string, last_feedback int, last_ts timestamp_ntz, last_seq bigint"
CLEAN_SCHEMA = ("question_id string, answer_prose string, answer_code_blocks array<string>, "
                "question_prose string, tags_list array<string>, text_for_embedding string")


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream over the parquet files that arrive under ``path`` (a folder, a file or a glob)."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def table_stream(spark: SparkSession, sf_dir: str, name: str,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over one table of ``sf_dir`` (schema from the batch table)."""
    # As a glob, the name may be one file or a folder of part files.
    return file_stream(spark, f"{sf_dir}/{name}.[p]arquet", tables.table(spark, sf_dir, name).schema,
                       max_files_per_trigger)


def run_job(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", per_batch=None) -> None:
    """Run ``stream`` to the end of its input; batch N (through ``per_batch``, if given) replaces ``batch_id=N``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = per_batch(batch) if per_batch else batch
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = (stream.writeStream.outputMode(mode).foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def read_batches(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """All rows a job has written, with their ``batch_id``."""
    full = f"{schema}, batch_id bigint"
    try:
        return spark.read.schema(full).parquet(out)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def query_volume_job(logs: DataFrame, out: str, checkpoint: str, mode: str = "update",
                     delay: str = "1 hour") -> None:
    """Queries per hour of a query-log stream; rows may be ``delay`` out of order between batches."""
    # Watermarks need a zoned timestamp; the table's is local (session is UTC).
    lg = logs.withColumn("event_time", F.col("timestamp").cast("timestamp"))
    counts = (lg.withWatermark("event_time", delay)
              .groupBy(F.window("event_time", "1 hour").alias("w"))
              .agg(F.count(F.lit(1)).alias("queries"))
              .select(F.col("w.start").cast("timestamp_ntz").alias("time"), "queries"))
    run_job(counts, out, checkpoint, mode)


def read_query_volume(spark: SparkSession, out: str) -> DataFrame:
    """X1's result: (time, queries), the last version of every hour."""
    return read_batches(spark, out, VOLUME_SCHEMA).groupBy("time").agg(
        F.max_by("queries", "batch_id").alias("queries"))


def feedback_job(feedback: DataFrame, out: str, checkpoint: str) -> None:
    """Each micro-batch's last feedback per session."""
    def last(batch: DataFrame) -> DataFrame:
        return batch.groupBy("session_id").agg(
            F.max_by(F.struct("feedback", "ts", "seq"), F.struct("ts", "seq")).alias("f")).select(
            "session_id", F.col("f.feedback").cast("int").alias("last_feedback"),
            F.col("f.ts").cast("timestamp_ntz").alias("last_ts"), F.col("f.seq").cast("bigint").alias("last_seq"))

    run_job(feedback, out, checkpoint, per_batch=last)


def read_feedback(spark: SparkSession, out: str) -> DataFrame:
    """X2's result: (session_id, last_feedback, last_ts) over all batches."""
    rows = read_batches(spark, out, FEEDBACK_SCHEMA)
    return last_feedback(rows.select("session_id", F.col("last_feedback").alias("feedback"),
                                     F.col("last_ts").alias("ts"), F.col("last_seq").alias("seq")))


def clean_job(pairs: DataFrame, out: str, checkpoint: str, within: str = "7 days", **limits) -> None:
    """Pairs cleaned as they arrive; repeats of a record's content within ``within`` are dropped."""
    content = F.sha2(F.to_json(F.struct(*pairs.columns), {"ignoreNullFields": "false"}), 256)
    fresh = (pairs.withColumns({"_arrived": F.current_timestamp(), "_content": content})
             .withWatermark("_arrived", within).dropDuplicatesWithinWatermark(["_content"])
             .drop("_arrived", "_content"))
    cleaned = clean_pairs(fresh, **limits).select(
        "question_id", "answer_prose", "answer_code_blocks", "question_prose", "tags_list", "text_for_embedding")
    run_job(cleaned, out, checkpoint)


def read_clean(spark: SparkSession, out: str) -> DataFrame:
    """X3's result: the cleaned records."""
    return read_batches(spark, out, CLEAN_SCHEMA).drop("batch_id")


def _fresh(spark: SparkSession, job: str) -> tuple[str, str]:
    """New output and checkpoint folders below the session's checkpoint folder."""
    base = os.path.join(ensure_checkpoint_dir(spark).replace("file:", ""), "streams", f"{job}-{uuid.uuid4().hex[:12]}")
    return os.path.join(base, "out"), os.path.join(base, "checkpoint")


def stream_query_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 over the event stream."""
    out, checkpoint = _fresh(spark, "query_volume")
    query_volume_job(tables.query_logs_from(table_stream(spark, sf_dir, "events")), out, checkpoint)
    return read_query_volume(spark, out)


def stream_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2 over the event stream, applied to the log."""
    out, checkpoint = _fresh(spark, "feedback")
    feedback_job(tables.feedback_from(table_stream(spark, sf_dir, "events")), out, checkpoint)
    lg = tables.query_logs(spark, sf_dir).join(read_feedback(spark, out), "session_id", "left")
    fbv = F.when(F.col("last_ts") >= F.col("timestamp"), F.col("last_feedback")).cast("int")
    return lg.select("id", "session_id", fbv.alias("user_feedback"))


def stream_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cleaned as they arrive (reference limits)."""
    out, checkpoint = _fresh(spark, "clean")
    clean_job(tables.corpus_from(table_stream(spark, sf_dir, "documents")), out, checkpoint)
    return read_clean(spark, out)
