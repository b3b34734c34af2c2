"""Driver tables and the adapters that give them the reference's shapes.

``documents`` becomes a Q&A corpus, ``conversations`` a post dump, ``events`` a
query log plus a feedback stream (FIXTURES.md part C).  Every adapter is a
projection over the source table, so Catalyst prunes columns and pushes
filters through it into the parquet scan.
"""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.text import WS
from quillrank.operators.util import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


# Per session: what the files behind each table path looked like when last read.
_SEEN: WeakKeyDictionary = WeakKeyDictionary()


def _files(spark: SparkSession, path: str) -> tuple:
    """One row about a table's files (count, bytes, names and times); their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return tuple(files.agg(F.count("*"), F.sum("length"),
                           F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table.  Spark matches cached frames by path, so when the files have
    changed since the session last read them, what was cached from them is refreshed."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    seen, now = _SEEN.setdefault(spark, {}), _files(spark, path)
    if seen.get(path, now) != now:
        spark.catalog.refreshByPath(path)
    seen[path] = now
    return spark.read.parquet(path)


def _first8(text: Column) -> Column:
    # A split with a limit still searches the whole text, so the beginning with eight tokens at most is taken first.
    head = F.regexp_extract(text, r"(?U)\A\s*+(?:\S++\s*+){0,8}", 0)
    return F.array_join(F.slice(F.array_remove(F.split(head, WS), ""), 1, 8), " ")


def _date_from(base: str, days: Column) -> Column:
    return F.date_format(F.date_add(F.lit(base).cast("date"), days.cast("int")), "yyyy-MM-dd")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` -> qa_pairs shape (A3) plus ``seq`` = corpus position."""
    return corpus_from(spread(table(spark, sf_dir, "documents"), "doc_id"))


def corpus_from(d: DataFrame) -> DataFrame:
    """The corpus projection over a ``documents`` frame (batch or stream)."""
    qid = d.doc_id.cast("string")
    title = _first8(d.text)
    return d.select(
        F.md5(qid).alias("doc_id"),
        qid.alias("question_id"),
        title.alias("question_title"),
        F.concat(F.lit("<p>"), title, F.lit("</p>")).alias("question_body"),
        ((d.doc_id * 37) % 97).cast("int").alias("question_score"),
        F.concat(F.lit("<"), d.lang, F.lit("><"), d.source, F.lit(">")).alias("tags"),
        _date_from("2020-01-01", d.doc_id % 1461).alias("creation_date"),
        F.concat(F.lit("<p>"), d.text, F.lit("</p>")).alias("accepted_answer"),
        ((d.doc_id * 13) % 41).cast("int").alias("answer_score"),
        F.concat(F.lit("https://example.org/q/"), qid).alias("question_url"),
        d.doc_id.alias("seq"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` -> post rows (A2 shape, all strings) plus ClosedDate and seq."""
    c = table(spark, sf_dir, "conversations")
    pid = c.conv_id * 1000 + c.turn
    return c.select(
        pid.cast("string").alias("Id"),
        F.when(c.role == "user", "1").when(c.role == "assistant", "2").otherwise("4")
        .alias("PostTypeId"),
        F.when(c.role == "user", (pid + 1).cast("string")).alias("AcceptedAnswerId"),
        ((c.conv_id * 7 + c.turn) % 20).cast("string").alias("Score"),
        F.when(c.conv_id % 3 != 0,
               F.concat(F.lit("<python><t"), (c.conv_id % 5).cast("string"), F.lit(">")))
        .otherwise(F.lit("<java>")).alias("Tags"),
        _date_from("2019-07-01", (c.conv_id * 7) % 900).alias("CreationDate"),
        F.when(c.conv_id % 11 == 0, F.lit("2024-01-01")).alias("ClosedDate"),
        _first8(c.text).alias("Title"),
        F.concat(F.lit("<p>"), c.text, F.lit("</p>")).alias("Body"),
        pid.alias("seq"),
    )


def _k(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("int")


def query_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` (view/click/purchase) -> query_logs shape (A12) + rewritten_queries."""
    return query_logs_from(table(spark, sf_dir, "events"))


def query_logs_from(events: DataFrame) -> DataFrame:
    """The query-log projection over an ``events`` frame (batch or stream)."""
    e = events.where(F.col("event_type").isin("view", "click", "purchase"))
    v = e.value
    k = _k(e.props)
    parts = [F.floor(v), F.floor(v * 2), F.floor(v * 3), F.floor(v * 10), F.floor(v * 5)]
    return e.select(
        e.event_id.alias("id"),
        F.concat(F.lit("u"), e.user_id.cast("string")).alias("session_id"),
        e.ts.alias("timestamp"),
        F.concat(e.event_type, F.lit(" "), e.props).alias("question"),
        F.when(e.event_id % 10 == 0, F.lit(None).cast("int"))
        .otherwise((1 + e.event_id % 5).cast("int")).alias("judge_relevance"),
        (1 + F.expr("event_id div 5") % 5).cast("int").alias("judge_accuracy"),
        (1 + k % 5).alias("judge_completeness"),
        parts[0].cast("int").alias("rewrite_ms"),
        parts[1].cast("int").alias("retrieval_ms"),
        parts[2].cast("int").alias("reranker_ms"),
        parts[3].cast("int").alias("generation_ms"),
        parts[4].cast("int").alias("judge_ms"),
        (parts[0] + parts[1] + parts[2] + parts[3] + parts[4]).cast("int").alias("total_ms"),
        F.array(e.event_type,
                F.concat(e.event_type, F.lit("-"), (k % 7).cast("string"))).alias("rewritten_queries"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` (signup/error) -> feedback rows (A10) + ts, seq."""
    return feedback_from(table(spark, sf_dir, "events"))


def feedback_from(events: DataFrame) -> DataFrame:
    """The feedback projection over an ``events`` frame (batch or stream)."""
    e = events.where(
        F.col("event_type").isin("signup", "error"))
    return e.select(
        F.concat(F.lit("u"), e.user_id.cast("string")).alias("session_id"),
        e.ts,
        e.event_id.alias("seq"),
        F.when(e.event_type == "signup", 1).otherwise(-1).alias("feedback"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` -> requests with mixed parameters, some left out and some out of range."""
    b = table(spark, sf_dir, "benchmark")
    i = b.item_id
    return b.select(
        i.alias("query_id"), b.text.alias("question"),
        F.when(i % 5 != 0, (i % 7) * 15).when(i % 10 == 0, F.lit(900)).cast("int").alias("min_vote_score"),
        F.when(i % 3 == 0, F.array(F.lit("en"), F.lit("de"))).when(i % 3 == 1, F.array(F.concat(F.lit("src"), (i % 20).cast("string"))))
        .alias("tags"),
        F.when(i % 13 == 0, "June 2021").when(i % 4 == 0, "2021-06-01").when(i % 4 == 1, "2023-12-20").alias("after_date"),
        F.when(i % 6 != 0, 1 + i % 22).cast("int").alias("top_k"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` -> a batch of questions: (query_id, question)."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(b.item_id.alias("query_id"), b.text.alias("question"))
