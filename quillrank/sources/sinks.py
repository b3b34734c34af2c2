"""Sinks.  Counts come from ``observe`` on the write itself,
so reporting them costs no second pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.text import md5_hex, md5_to_uuid
from quillrank.operators.clean import with_clean_columns
from quillrank.operators.index import Bm25Index
from quillrank.operators.pairs import keep_last
from quillrank.sources.readers import read_vectors


def write_jsonl(df: DataFrame, path: str) -> int:
    """K1/K5: JSON lines, overwrite, nulls written as null; returns rows written."""
    obs = Observation("jsonl")
    (df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
     .option("ignoreNullFields", False).json(path))
    return int(obs.get["rows"])


def write_clean(pairs: DataFrame, path: str, **limits) -> dict:
    """K2: cleaned pairs written; returns total / kept / filtered of the same pass."""
    obs = Observation("clean")
    flagged = with_clean_columns(pairs, **limits).observe(
        obs, F.count(F.lit(1)).alias("total"), F.count_if(F.col("keep")).alias("kept"))
    flagged.where(F.col("keep")).drop("keep").write.mode("overwrite").parquet(path)
    got = obs.get
    return {"total": got["total"], "kept": got["kept"], "filtered": got["total"] - got["kept"]}


PAYLOAD = ["doc_id", "question_id", "question_title", "question_url", "answer_prose", "tags_list",
           "question_score", "answer_score", "creation_date"]


def write_vectors(vectors: DataFrame, path: str, key: str = "doc_id",
                  order_col: str = "seq") -> None:
    """K3: one vector per document -- the last by ingest order wins -- and the
    table replaced whole, so vectors and the BM25 index cannot drift apart."""
    keep_last(vectors, [key], order_col).write.mode("overwrite").parquet(path)


def vector_points(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """K3: points of a vector table: id (the document id as UUID), ``seq``, ``embedding`` and the nine payload
    fields, missing ones empty.  ``docs`` holds ``seq`` and payload columns, ``vectors`` (seq, embedding).  A document
    without ``doc_id`` has the one of its question; those without either are one point."""
    empty = {"tags_list": F.array().cast("array<string>"), "question_score": F.lit(0).cast("bigint"),
             "answer_score": F.lit(0).cast("bigint")}
    types = {"tags_list": "array<string>", "question_score": "bigint", "answer_score": "bigint"}
    payload = [F.coalesce(F.col(c).cast(types.get(c, "string")) if c in docs.columns else F.lit(None),
                          empty.get(c, F.lit(""))).alias(c) for c in PAYLOAD]
    return (docs.select("seq", *payload).join(vectors.select("seq", "embedding"), "seq")
            .withColumn("doc_id", F.when(F.col("doc_id") == "", md5_hex("question_id")).otherwise(F.col("doc_id")))
            .select(md5_to_uuid("doc_id").alias("point_id"), "seq", "embedding", *PAYLOAD))


def upsert_vectors(points: DataFrame, path: str, version: int) -> None:
    """K3: ingest run ``version`` of a vector table: its points, the last per document.  A run adds a folder and
    touches no other, so earlier versions stay readable; a run that is repeated replaces its own folder.
    ``readers.read_vectors`` merges the runs."""
    keep_last(points, ["point_id"], "seq").write.mode("overwrite").parquet(f"{path}/version={int(version)}")


def compact_vectors(spark: SparkSession, path: str, into: str, version: int | None = None) -> None:
    """The table as of ``version`` (the latest if None) as the first run of a new table at ``into``."""
    upsert_vectors(read_vectors(spark, path, version), into, 0)


def write_index(index: Bm25Index, path: str) -> None:
    """K4: the index as four parquet tables; a later job reads them with
    ``readers.read_index`` instead of rebuilding (and they cut lineage)."""
    index.doc_terms.write.mode("overwrite").parquet(f"{path}/doc_terms")
    index.term_stats.write.mode("overwrite").parquet(f"{path}/term_stats")
    index.corpus_stats.write.mode("overwrite").parquet(f"{path}/corpus_stats")
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")


def write_metrics(summary: DataFrame, path: str) -> None:
    """K6: a metrics summary (a handful of rows) as one JSON file."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """K7: append query-log rows."""
    rows.write.mode("append").parquet(path)


def append_feedback(rows: DataFrame, path: str) -> None:
    """K8: append feedback rows; ``logs.with_feedback`` applies them on read."""
    rows.write.mode("append").parquet(path)
