"""BM25 index as tables.

* ``doc_terms(seq, terms, tfs, dls, attrs)`` -- one row per document: its distinct
  terms, their frequencies, the document's length beside each, and the columns that filters look at; stored as
  ``compact(seq, terms, counts, dl, attrs)``, with the terms as one string and the frequencies as bytes, where no seq repeats;
* ``vectors(seq, embedding, attrs)`` -- if asked for, the hashed vectors of the same tokens, which are counted once for both;
* ``postings(seq, term, tf, dl)`` -- the same, one row per (document, distinct term);
* ``term_stats(term, n_t)`` -- documents holding the term;
* ``corpus_stats(n_docs, avgdl, mean_idf)`` -- one row.

A document's terms are counted where its text lies (``counting``), so no token is
shuffled.  Term statistics are added up by the same tasks before their shuffle, so a term
held by a third of the corpus costs a few rows per task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from quillrank.operators import dense
from quillrank.operators.counting import as_lists, compact, expanded, keys_repeat, token_counts, token_runs, token_text
from quillrank.operators.util import materialize

# BM25Okapi constants (library defaults the reference relies on).
K1 = 1.5
B = 0.75
EPSILON = 0.25


@dataclass
class Bm25Index:
    doc_terms: DataFrame     # seq, terms, tfs, dls, attrs: one row per seq
    term_stats: DataFrame    # term, n_t, raw_idf
    corpus_stats: DataFrame  # n_docs, sum_dl, avgdl, mean_idf (one row)
    docs: DataFrame          # indexed documents: seq, dl + payload, for fill and late joins
    compact: DataFrame | None = None  # doc_terms as Spark moves it cheaply, where no seq repeats: seq, terms, counts, dl, attrs
    vectors: DataFrame | None = None  # seq, embedding, attrs of documents with a token, where asked for and no seq repeats

    @property
    def scored(self) -> DataFrame:
        """What a search reads: the documents' terms in either form."""
        return self.doc_terms if self.compact is None else self.compact

    @property
    def postings(self) -> DataFrame:
        """seq, term, tf, dl."""
        return flat_postings(self.doc_terms)

    def hold(self):
        """Each table is read by several branches of a search plan (and by
        every later batch): write them now instead of recomputing."""
        return Bm25Index(materialize(self.doc_terms), materialize(self.term_stats),
                         materialize(self.corpus_stats), self.docs, self.compact, self.vectors)

    def checkpoint(self):
        """Cut lineage into the session's checkpoint folder (a shared folder on
        a cluster), so a lost executor recomputes from here, not from the scan."""
        return Bm25Index(self.doc_terms.checkpoint(), self.term_stats.checkpoint(),
                         self.corpus_stats.checkpoint(), self.docs, self.compact and self.compact.checkpoint(),
                          self.vectors and self.vectors.checkpoint())


def raw_idf(n_docs, n_t):
    """``ln(N - n + 0.5) - ln(n + 0.5)`` (before the negative-idf floor)."""
    return F.log(n_docs - n_t + F.lit(0.5)) - F.log(n_t + F.lit(0.5))


# What the filters of searches look at.
FILTER_COLS = ["question_score", "tags_list", "creation_date"]


def flat_postings(doc_terms: DataFrame) -> DataFrame:
    p = F.explode(F.arrays_zip("terms", "tfs", "dls")).alias("p")
    return doc_terms.select("seq", p).select("seq", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"),
                                             F.col("p.dls").alias("dl"))


# Entries of term counts that a task adds up at a time, about.
COUNTED_TERMS = 1 << 19


class _TermCounts:
    """Documents that hold each term, added up over the runs of a task."""

    def __init__(self):
        self.held, self.n = [], 0

    def add(self, words: pa.Array, n: np.ndarray) -> bool:
        """Whether the counts held are now so many that they should go on."""
        self.held.append((words, n))
        self.n += self._weight(words)
        if self.n <= COUNTED_TERMS:
            return False
        self._merge()
        return self.n > COUNTED_TERMS // 2

    @staticmethod
    def _weight(words: pa.Array) -> int:
        """Its entries; very long terms count more, as they take more memory."""
        return max(len(words), words.nbytes // 128)

    def _merge(self):
        if len(self.held) > 1:   # a run's terms are distinct
            coded = pa.concat_arrays([words for words, _ in self.held]).dictionary_encode()
            n = np.bincount(np.asarray(coded.indices), np.concatenate([n for _, n in self.held]), len(coded.dictionary))
            self.held = [(coded.dictionary, n.astype(np.int64))]
        self.n = self._weight(self.held[0][0])

    def take(self) -> pa.StructArray | None:
        """What is held, once a term, and none of it any more."""
        if not self.held:
            return None
        self._merge()
        (words, n), self.held, self.n = self.held[0], [], 0
        return pa.StructArray.from_arrays([words, pa.array(n, pa.int64())], ["term", "n"]) if len(words) else None


TERM_LISTS = ["seq", "terms", "tfs", "dls", "attrs"]


def _listed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of compact rows as TERM_LISTS (those that it has)."""
    terms, tf, row = expanded(batch.column("terms"), batch.column("counts"))
    dl = np.asarray(batch.column("dl"))[row]
    n = batch.num_rows
    made = {"terms": as_lists(terms, row, n), "tfs": as_lists(pa.array(tf, pa.int32()), row, n),
            "dls": as_lists(pa.array(dl, pa.int32()), row, n)}
    names = [c for c in TERM_LISTS if c in made or c in batch.schema.names]
    return pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in names], names)


def listed(batches):
    """Batches of either form of the documents' terms as TERM_LISTS."""
    for batch in batches:
        yield _listed(batch) if "counts" in batch.schema.names else batch


def _lists_schema(rows: DataFrame) -> StructType:
    ints = ArrayType(IntegerType())
    return StructType([StructField("seq", rows.schema["seq"].dataType), StructField("terms", ArrayType(StringType())),
                       StructField("tfs", ints), StructField("dls", ints), StructField("attrs", rows.schema["attrs"].dataType)])


def compact_terms(clean: DataFrame, text, vector_rest=None) -> DataFrame:
    """(seq, terms, counts, dl, attrs, held), one row a row of ``clean``, whose ``held`` is null; the rows with ``held``
    (term, n) are no documents: each tells of part of the documents how many hold a term.  With ``vector_rest``, a text
    of the row, also ``idx`` and ``val``: ``dense.embed_counts`` of the tokens of ``text`` and of it, none where it is null."""
    rows = _token_rows(clean, text, vector_rest)
    vector = [] if vector_rest is None else ["idx", "val"]
    names = ["seq", "terms", "counts", "dl", "attrs", *vector, "held"]
    pairs = pa.list_(pa.struct([("term", pa.string()), ("n", pa.int64())]))

    def run(batches):
        held, types = _TermCounts(), None

        def summary():
            found = held.take()
            if found is not None:
                lists = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types), lists], names)

        for batch in batches:
            for part in token_runs(batch, "toks"):
                words, row, code, n = token_counts(part.column("toks"))
                dl = np.bincount(row, weights=n, minlength=part.num_rows).astype(np.int32)
                found = [part.column("seq"), *compact(words, row, code, n, part.num_rows), pa.array(dl), part.column("attrs")]
                if vector:
                    rest = part.column("rest")
                    has = np.asarray(rest.is_valid())[row]
                    found += dense.embed_counts([(words, row[has], code[has], n[has]),
                                                 token_counts(pc.split_pattern(rest, " "))], part.num_rows)
                types = [a.type for a in found]
                yield pa.RecordBatch.from_arrays([*found, pa.nulls(part.num_rows, pairs)], names)
                n_t = np.bincount(code, minlength=len(words))
                if held.add(words.take(pa.array(np.flatnonzero(n_t))), n_t[n_t > 0]):
                    yield from summary()
        yield from summary()

    count = StructType([StructField("term", StringType()), StructField("n", LongType())])
    return rows.mapInArrow(run, StructType([
        StructField("seq", rows.schema["seq"].dataType), StructField("terms", StringType()), StructField("counts", BinaryType()),
        StructField("dl", IntegerType()), StructField("attrs", rows.schema["attrs"].dataType),
        *(StructField(c, BinaryType()) for c in vector), StructField("held", ArrayType(count))]))


def _token_rows(clean: DataFrame, text, rest=None) -> DataFrame:
    attrs = F.array(F.struct(*[F.col(c) if c in clean.columns else F.lit(None).cast(t).alias(c) for c, t in
                               zip(FILTER_COLS, ("int", "array<string>", "string"))])).alias("attrs")
    more = [] if rest is None else [token_text(rest).alias("rest")]
    return clean.select("seq", attrs, token_text(text).alias("toks"), *more)


def document_terms(clean: DataFrame, text, repeats: bool = True) -> DataFrame:
    """(seq, terms, tfs, dls, attrs), one row per ``seq``.

    With ``repeats`` rows of one ``seq`` are merged: those of one length add up their frequencies, those of different
    lengths keep postings of their own.  Without, every row is a document, and nothing is shuffled."""
    rows = _token_rows(clean, text)

    def run(batches):
        for batch in batches:
            for part in token_runs(batch, "toks"):
                words, row, code, n = token_counts(part.column("toks"))
                dl = np.bincount(row, weights=n, minlength=part.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    part.column("seq"), as_lists(words.take(pa.array(code)), row, part.num_rows),
                    as_lists(pa.array(n, pa.int32()), row, part.num_rows),
                    as_lists(pa.array(dl[row], pa.int32()), row, part.num_rows), part.column("attrs")], TERM_LISTS)

    counted = rows.mapInArrow(run, _lists_schema(rows))
    if not repeats:
        return counted
    # The rows' postings meet again as one row each: (length, term, frequency) within a document, never a corpus.
    per_term = flat_postings(counted).groupBy("seq", "dl", "term").agg(F.sum("tf").cast("int").alias("tf"))
    lists = per_term.groupBy("seq").agg(F.collect_list(F.struct("term", "tf", "dl")).alias("p"))
    rows = counted.groupBy("seq").agg(F.flatten(F.collect_list("attrs")).alias("attrs"))
    held = rows.alias("r").join(lists.alias("l"), F.col("r.seq").eqNullSafe(F.col("l.seq")), "left")
    return held.select("r.seq", *[F.coalesce(F.col(f"l.p.{c}"), F.array().cast(t)).alias(n) for c, t, n in (
        ("term", "array<string>", "terms"), ("tf", "array<int>", "tfs"), ("dl", "array<int>", "dls"))], "r.attrs")


def term_counts(doc_terms: DataFrame) -> DataFrame:
    """(term, n_t): documents that hold each term, counted per batch first."""
    def run(batches):
        for batch in batches:
            found = pc.value_counts(batch.column("terms").flatten())
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["term", "n"])

    return (doc_terms.select("terms").mapInArrow(run, "term string, n bigint")
            .groupBy("term").agg(F.sum("n").alias("n_t")))


def build_index(clean: DataFrame, payload: list[str] | None = None,
                hold: bool = True, vector_rest=None) -> Bm25Index:
    """R1 over a cleaned corpus with a ``seq`` column (corpus position).

    ``docs`` (seq, dl, payload) and the documents' terms are read by several branches
    of every search; they are written here (``hold=False`` leaves everything lazy).
    With ``vector_rest``, a text of each row, the ``vectors`` of title, answer and that text are counted with the
    terms, unless a seq repeats or nothing is held.
    """
    payload = payload if payload is not None else [
        c for c in ("doc_id", "question_id", "question_score", "tags_list", "creation_date")
        if c in clean.columns]
    text = F.concat(F.coalesce(F.col("question_title"), F.lit("")), F.lit(" "),
                    F.coalesce(F.col("answer_prose"), F.lit("")))
    repeats, vectors = not hold or keys_repeat(clean, ["seq"]), None
    if repeats:
        doc_terms, rows = document_terms(clean, text), None
        if hold:
            doc_terms = materialize(doc_terms)
        n_t = term_counts(doc_terms)
        lengths = doc_terms.select("seq", F.array_max("dls").alias("dl"))
    else:   # terms are counted as the documents are
        both = materialize(compact_terms(clean, text, vector_rest))
        rows = both.where(F.col("held").isNull()).drop("held", "idx", "val")
        if vector_rest is not None:
            vectors = both.where(F.col("held").isNull() & (F.octet_length("val") > 0)).select(
                "seq", F.struct("idx", "val", F.lit(dense.HASH_DIM).alias("dim")).alias("embedding"), "attrs")
        doc_terms = rows.mapInArrow(listed, _lists_schema(rows))
        n_t = (both.where(F.col("held").isNotNull()).select(F.inline("held"))
               .groupBy("term").agg(F.sum("n").alias("n_t")))
        lengths = rows.select("seq", "dl")
    # Documents without a token keep dl = 0.
    docs = (clean.select("seq", *payload).join(lengths, "seq", "left")
            .withColumn("dl", F.coalesce(F.col("dl"), F.lit(0))))
    if hold:
        docs = docs.persist()  # small; filled by its first reader
    sizes = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("dl").cast("bigint").alias("sum_dl"))
    # idf needs N: join the one-row statistics frame (no driver round trip).
    term_stats = n_t.crossJoin(F.broadcast(sizes.select("n_docs"))).select(
        "term", "n_t", raw_idf(F.col("n_docs"), F.col("n_t")).alias("raw_idf"))
    if hold:
        term_stats = materialize(term_stats)
    # Mean idf over every term, summed exactly (order-free) as a decimal.
    mean = term_stats.agg(
        (F.sum(F.col("raw_idf").cast("decimal(30,12)")).cast("double")
         / F.count(F.lit(1)).cast("double")).alias("mean_idf"))
    corpus_stats = sizes.crossJoin(mean).select(
        "n_docs", "sum_dl",
        (F.col("sum_dl").cast("double") / F.col("n_docs").cast("double")).alias("avgdl"),
        "mean_idf")
    if hold:
        corpus_stats = corpus_stats.persist()  # one row
    return Bm25Index(doc_terms, term_stats, corpus_stats, docs, rows, vectors)
