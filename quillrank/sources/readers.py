"""Sources: every read has an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.operators.index import Bm25Index

EXPORT_COLUMNS = ["Id", "Title", "Body", "Score", "Tags", "CreationDate",
                  "AcceptedAnswerBody", "AnswerScore"]
POST_ATTRIBUTES = ["Id", "PostTypeId", "AcceptedAnswerId", "Score", "Tags", "CreationDate",
                   "ClosedDate", "Title", "Body"]
# Strings pandas reads as missing (only with ``na_strings=True``).
NA_STRINGS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
              "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

PAIR_SCHEMA = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("question_id", T.StringType()),
    T.StructField("question_title", T.StringType()), T.StructField("question_body", T.StringType()),
    T.StructField("question_score", T.LongType()), T.StructField("tags", T.StringType()),
    T.StructField("creation_date", T.StringType()), T.StructField("accepted_answer", T.StringType()),
    T.StructField("answer_score", T.LongType()), T.StructField("question_url", T.StringType()),
])


def load_posts_csv(spark: SparkSession, path: str, columns: list[str] = EXPORT_COLUMNS,
                   na_strings: bool = False) -> DataFrame:
    """Export CSV, every column a string, missing -> ''.  Bodies hold
    newlines and quotes, hence multiLine with doubled-quote escaping."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = (spark.read.schema(schema).option("header", True).option("multiLine", True)
          .option("quote", '"').option("escape", '"').option("mode", "FAILFAST").csv(path))
    if na_strings:
        df = df.select(*[F.when(F.col(c).isin(NA_STRINGS), None).otherwise(F.col(c)).alias(c)
                         for c in columns])
    return df.na.fill("")


def load_posts_xml(spark: SparkSession, path: str,
                   attributes: list[str] = POST_ATTRIBUTES) -> DataFrame:
    """One row per ``<row .../>`` element, attributes as string columns
    (a missing attribute is null)."""
    schema = T.StructType([T.StructField(f"_{a}", T.StringType()) for a in attributes])
    df = spark.read.format("xml").option("rowTag", "row").schema(schema).load(path)
    return df.select(*[F.col(f"_{a}").alias(a) for a in attributes])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = PAIR_SCHEMA) -> DataFrame:
    """S3: JSON lines with an explicit schema; a malformed line fails the read.
    Blank lines are skipped by the reader."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


GT_SCHEMA = T.StructType([
    T.StructField("gt_rank", T.IntegerType()), T.StructField("question_id", T.StringType()),
    T.StructField("question_title", T.StringType()), T.StructField("question_body", T.StringType()),
    T.StructField("question_url", T.StringType()), T.StructField("accepted_answer", T.StringType()),
    T.StructField("tags_list", T.ArrayType(T.StringType())),
    T.StructField("question_score", T.LongType()),
])


def read_ground_truth(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first ``n`` ground-truth items (JSON lines written by K5),
    by their written rank rather than file order."""
    return read_jsonl(spark, path, GT_SCHEMA).where(F.col("gt_rank") <= n)


def read_index(spark: SparkSession, path: str) -> Bm25Index:
    """An index written by ``sinks.write_index``."""
    return Bm25Index(spark.read.parquet(f"{path}/doc_terms"), spark.read.parquet(f"{path}/term_stats"),
                     spark.read.parquet(f"{path}/corpus_stats"), spark.read.parquet(f"{path}/docs"))


def read_vectors(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """K3: the vector table written by ``sinks.upsert_vectors`` as of ``version`` (the latest if None): of every
    point its last run's row.  Only (point, run) pairs meet in a shuffle, not the vectors: rows of older runs are
    dropped by a join with the points that a later run holds again."""
    runs = spark.read.parquet(path)
    if version is not None:
        runs = runs.where(F.col("version") <= version)
    again = (runs.groupBy("point_id").agg(F.max("version").alias("last"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").drop("n"))
    return (runs.join(again, "point_id", "left").where(F.col("last").isNull() | (F.col("version") == F.col("last")))
            .drop("last", "version"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The appended query log."""
    return spark.read.parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A metrics summary written by ``sinks.write_metrics``."""
    return spark.read.option("multiLine", False).json(path)
