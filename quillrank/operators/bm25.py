"""Batch BM25 search.

All questions of a batch are scored in one job:

    weighted query terms, dealt into blocks of queries (measured, broadcast if small)
    -> every block of queries meets every block of documents in a join
    -> a task sums the contributions of a pair of blocks with numpy and keeps,
       per query, the block's k best matches
    -> top-k per query (row_number <= k, planned as WindowGroupLimit, whose
       partial limit runs before the shuffle).

A (query, document) pair is a cell of a bounded matrix, never a row, unless it is
among its block's k best.

Exactness rules (SURVEY 7.4):

* contributions are rounded to integers of 1e-9 and summed as BIGINT: exact,
  so the sum does not depend on the order rows meet in the shuffle, and on
  the fast fixed-width path (a DECIMAL(38,x) sum would go through BigDecimal);
* ranking is on the score rounded to 6 places (integer micro-units), ties
  broken by corpus position (``seq``), the reference's stable-sort order;
* corpus statistics are global; metadata filters only restrict which documents
  may be returned, so their postings alone are scored;
* zero fill: the reference ranks every document, so when fewer than k
  documents score, the list is completed by unmatched documents (score 0) in
  corpus order.  The first k allowed documents by position (a global top-k,
  k rows per task) cover every case whose scores are not negative; when the
  corpus mean idf is negative (so matches can score below 0) the fill widens
  by the largest number of negative-scored matches of any question.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillrank.functions.text import bm25_tokens
from quillrank.operators.counting import counted, expanded, runs, sizes
from quillrank.operators.dense import DOC_FILTERS, QUERY_FILTERS, allowed, cut, packed, unpacked
from quillrank.operators.index import B, EPSILON, K1, Bm25Index
from quillrank.operators.util import BROADCAST_MAX_BYTES, materialize

NANO = 1e9
# Postings of a block of documents, about (one document at least), and its documents at most.
BLOCK_POSTINGS, BLOCK_DOCS = 1 << 17, 1 << 10
# Cells (terms x queries) of a block of queries, about, and pairs of a posting and a query with its term that a step works on.
QUERY_CELLS = 1 << 21
STEP_CELLS = 1 << 18


def query_terms(queries: DataFrame, key_cols: list[str], text_col: str) -> DataFrame:
    """Query tokens with repeats counted: (key..., term, qtf)."""
    return (queries.select(*key_cols, F.explode(bm25_tokens(F.col(text_col))).alias("term"))
            .groupBy(*key_cols, "term").agg(F.count(F.lit(1)).cast("int").alias("qtf")))


def contribution(idf, tf, dl, avgdl):
    """``idf * tf*(k1+1) / (tf + k1*(1 - b + b*dl/avgdl))`` in double."""
    denom = tf + K1 * ((1.0 - B) + (B * dl) / avgdl)
    return idf * ((tf * (K1 + 1.0)) / denom)


def lets(col, min_score: int | None = None, tags: list[str] | None = None, after_date: str | None = None):
    """F7/F8 predicate over a document's coalesced attributes; ``col(name)`` gives them."""
    ok = F.lit(True)
    if min_score is not None:
        ok = ok & (F.coalesce(col("question_score"), F.lit(0)) >= F.lit(min_score))
    if tags:
        ok = ok & F.arrays_overlap(F.coalesce(col("tags_list"), F.array().cast("array<string>")),
                                   F.array(*[F.lit(t) for t in tags]))
    if after_date:
        ok = ok & (F.coalesce(col("creation_date"), F.lit("")) >= F.lit(after_date))
    return ok


def doc_filter(docs: DataFrame, min_score: int | None = None, tags: list[str] | None = None,
               after_date: str | None = None) -> DataFrame:
    """F7/F8 predicates on the document side, over coalesced columns."""
    return docs.where(lets(F.col, min_score, tags, after_date))


def weighted_queries(index: Bm25Index, queries: DataFrame, key_cols: list[str], text_col: str,
                     filters: list[str]) -> DataFrame:
    """One row a key: its rows' ``params`` (the ``filters`` columns) and ``terms`` (term, qtf, idf, avgdl)."""
    stats = F.broadcast(index.corpus_stats.select("avgdl", "mean_idf"))
    qt = query_terms(queries, key_cols, text_col)
    idf = F.when(F.col("raw_idf") < 0, F.lit(EPSILON) * F.col("mean_idf")).otherwise(F.col("raw_idf"))
    term = F.struct("term", F.col("qtf").cast("bigint").alias("qtf"), idf.alias("idf"), "avgdl").alias("t")
    found = index.term_stats.join(materialize(qt), "term").crossJoin(stats).select(*key_cols, term)
    param = F.struct(F.lit(0).alias("_"), *filters).alias("p")
    # The left rows have no term, the right ones no parameters: every key keeps a row, whatever its terms.
    both = queries.select(*key_cols, param).unionByName(found, allowMissingColumns=True)
    return both.groupBy(*key_cols).agg(F.collect_list("p").alias("params"), F.collect_list("t").alias("terms"))


def _document_block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([packed(pa.Table.from_batches(held).combine_chunks())], pa.binary())], ["docs"])


def _document_blocks(batches):
    """Runs of rows of a partition, with about BLOCK_POSTINGS postings and no more than BLOCK_DOCS rows, without a shuffle.
    Compact rows stay compact."""
    held, rows, n = [], 0, 0
    for batch in batches:
        column, size = ("counts", counted) if "counts" in batch.schema.names else ("terms", sizes)
        for run in runs(batch, column, BLOCK_POSTINGS // 4):
            for at in range(0, run.num_rows, BLOCK_DOCS // 4):
                part = run.slice(at, BLOCK_DOCS // 4)
                held.append(part)
                rows, n = rows + part.num_rows, n + int(size(part.column(column)).sum())
                if n > BLOCK_POSTINGS // 4 * 3 or rows > BLOCK_DOCS // 4 * 3:
                    yield _document_block(held)
                    held, rows, n = [], 0, 0
    if held:
        yield _document_block(held)


def _query_block(table: pa.Table) -> pa.Table:
    number = table.column("block")[0].as_py()
    return pa.table({"block": pa.array([number], pa.int32()),
                     "queries": pa.array([packed(table.drop_columns(["block"]))], pa.binary())})


def _one(column) -> pa.Array:
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


class _Queries:
    """A block of queries: its terms with their weights, and which query holds which term how often."""

    def __init__(self, table: pa.Table):
        self.table, self.n = table, table.num_rows
        lists, params = _one(table.column("terms")), _one(table.column("params"))
        flat = lists.flatten()
        coded = flat.field("term").dictionary_encode()
        self.terms, self.term = coded.dictionary, np.asarray(coded.indices, dtype=np.int64)
        self.of = np.repeat(np.arange(self.n), sizes(lists))
        self.qtf = np.asarray(flat.field("qtf"), dtype=np.int64)
        self.idf = np.zeros(len(self.terms))
        self.idf[self.term] = np.asarray(flat.field("idf"), dtype=np.float64)
        self.avgdl = float(flat.field("avgdl")[0].as_py()) if len(flat) else 1.0
        self.params, self.param_starts = params.flatten(), np.cumsum(sizes(params)) - sizes(params)
        order = np.argsort(self.term, kind="stable")
        self.of, self.qtf = self.of[order], self.qtf[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.term, minlength=len(self.terms)))])
        self.most = int(np.bincount(self.of, weights=self.qtf, minlength=1).max())   # tokens of a query

    def holders(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``terms``, query, how often it holds the term): one entry a place and query that holds its term."""
        n = self.starts[terms + 1] - self.starts[terms]
        place = np.repeat(np.arange(len(terms)), n)
        at = np.arange(len(place)) + np.repeat(self.starts[terms] - (np.cumsum(n) - n), n)
        return place, self.of[at], self.qtf[at]


def _postings(docs: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, frequency, document's length, document) of a block's postings, by document."""
    if "counts" in docs.column_names:
        terms, tf, doc = expanded(_one(docs.column("terms")), _one(docs.column("counts")))
        return terms, tf, np.asarray(_one(docs.column("dl")))[doc], doc
    lists = _one(docs.column("terms"))
    tf, dl = (np.asarray(_one(docs.column(c)).flatten()) for c in ("tfs", "dls"))
    return lists.flatten(), tf, dl, np.repeat(np.arange(docs.num_rows), sizes(lists))


def _scores(docs: pa.Table, queries: _Queries) -> tuple[np.ndarray, np.ndarray]:
    """Documents x queries: the sums of contributions in units of 1e-9, and whether any term is shared."""
    terms, tf, dl, doc = _postings(docs)
    code = pc.index_in(terms, value_set=queries.terms)
    shared = np.flatnonzero(np.asarray(code.is_valid()))
    code = np.asarray(pc.fill_null(code, 0), dtype=np.int64)[shared]
    tf, dl, doc = tf[shared].astype(np.float64), dl[shared].astype(np.float64), doc[shared]
    weight = np.floor(contribution(queries.idf[code], tf, dl, queries.avgdl) * NANO + 0.5).astype(np.int64)
    nano, hit = np.zeros(docs.num_rows * queries.n, np.int64), np.zeros(docs.num_rows * queries.n, bool)
    # Doubles hold these whole numbers exactly, and are added up faster.
    exact = float(np.abs(weight).max(initial=0)) * queries.most < 2.0 ** 53
    ends = np.cumsum(queries.starts[code + 1] - queries.starts[code])
    at = 0
    while at < len(doc):   # a step's postings, by document
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP_CELLS, side="right")))
        place, query, qtf = queries.holders(code[at:to])
        cell, part = doc[at:to][place] * queries.n + query, weight[at:to][place] * qtf
        first, last = doc[at] * queries.n, (doc[to - 1] + 1) * queries.n
        if exact:
            nano[first:last] += np.bincount(cell - first, weights=part, minlength=last - first).astype(np.int64)
        else:
            np.add.at(nano, cell, part)
        hit[cell] = True
        at = to
    return nano.reshape(docs.num_rows, queries.n), hit.reshape(docs.num_rows, queries.n)


def _times(docs: pa.Table, queries: _Queries) -> np.ndarray:
    """Documents x queries: how many pairs of a document's attributes and a query's parameters fit."""
    attrs = _one(docs.column("attrs"))
    starts = np.cumsum(sizes(attrs)) - sizes(attrs)
    ok = allowed(_fields(attrs.flatten(), DOC_FILTERS), _fields(queries.params, QUERY_FILTERS)).astype(np.int64)
    return np.add.reduceat(np.add.reduceat(ok, starts, axis=0), queries.param_starts, axis=1)


def _fields(structs: pa.Array, names: list[str]) -> pa.Table:
    return pa.table({c: structs.field(c) for c in names})


def _meet(key_cols: list[str], k: int, filtered: bool, names: list[str]):
    """Each pair of a document and a query block: of every query its k best matches, and all that score below 0."""
    def run(batches):
        raw, queries, floor = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if raw is None or not raw.equals(batch.column(1)[i].as_buffer()):
                    raw = batch.column(1)[i].as_buffer()
                    queries = _Queries(unpacked(raw))
                    floor = np.full(queries.n, -np.inf)
                docs = unpacked(batch.column(0)[i].as_buffer())
                if not (docs.num_rows and len(queries.terms)):
                    continue
                total, hit = nano, _ = _scores(docs, queries)
                if filtered:
                    times = _times(docs, queries)
                    total, hit = nano * times, hit & (times > 0)
                # by position, null first
                order = np.asarray(pc.rank(_one(docs.column("seq")), null_placement="at_start", tiebreaker="dense"), dtype=np.int64)
                rows, cols = cut(np.where(hit, (total + 500) // 1000, -np.inf), order, k, floor=floor)
                low = hit & (total < 0)
                if low.any():
                    low[rows, cols] = True
                    rows, cols = np.nonzero(low)
                if len(rows):
                    found = [queries.table.column(c).take(pa.array(cols)) for c in key_cols]
                    table = pa.table([*found, docs.column("seq").take(pa.array(rows)), pa.array(nano[rows, cols])], names=names)
                    yield from table.combine_chunks().to_batches()
    return run


def match_scores(index: Bm25Index, queries: DataFrame, key_cols: list[str], text_col: str, k: int,
                 doc_terms: DataFrame | None = None, filters: list[str] | None = None) -> DataFrame:
    """(key..., seq, c): per query the documents that share a term with it, with the sum of their contributions --
    at least the ``k`` best (ties by position) and all below 0.  With ``filters`` (the columns of a query's own
    filter) only documents that it lets through."""
    filters = filters or []
    q = materialize(weighted_queries(index, queries, key_cols, text_col, filters))
    n_q, n_terms, n_bytes = q.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0)),
        F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("bigint")), F.lit(0))).first()
    n_blocks = max(1, math.ceil(math.sqrt(n_q * n_terms / QUERY_CELLS)))
    dealt = q.withColumn("block", F.pmod(F.xxhash64(*key_cols), F.lit(n_blocks)).cast("int"))
    blocks = dealt.groupBy("block").applyInArrow(_query_block, "block int, queries binary")
    # A query side within the bound goes to every task, and documents stay where they are.
    blocks = F.broadcast(blocks) if n_bytes <= BROADCAST_MAX_BYTES else blocks
    docs = index.scored if doc_terms is None else doc_terms
    docs = docs.select("seq", "terms", *(["counts", "dl"] if "counts" in docs.columns else ["tfs", "dls"]),
                       *(["attrs"] if filters else []))
    grid = (docs.mapInArrow(_document_blocks, "docs binary")
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(blocks, "block"))
    schema = StructType([*(q.schema[c] for c in key_cols), docs.schema["seq"], StructField("c", LongType())])
    return grid.select("docs", "queries").mapInArrow(_meet(key_cols, k, bool(filters), schema.names), schema)


def first_docs(docs: DataFrame, k: int) -> DataFrame:
    """One row holding the first ``k`` document positions (k rows per task move)."""
    return docs.select("seq").orderBy("seq").limit(k).agg(
        F.collect_list("seq").alias("fill"))


def _negative_allowance(index: Bm25Index, parts: DataFrame, key_cols: list[str]) -> int:
    """How far past k the zero fill must reach.

    Unmatched documents score 0.  They outrank matched documents only when
    those score below 0, which needs a negative idf floor -- a corpus whose
    mean idf is negative.  Then the fill must also cover as many extra
    positions as any question has negative-scored matches.  The check reads
    the one-row statistics frame; the count runs only in that rare case."""
    mean_idf = index.corpus_stats.select("mean_idf").first()
    if mean_idf is None or mean_idf[0] is None or mean_idf[0] >= 0:
        return 0
    neg = (parts.groupBy(*key_cols, "seq").agg(F.sum("c").alias("s")).where(F.col("s") < 0)
           .groupBy(*key_cols).count().agg(F.max("count")).first()[0])
    return int(neg or 0)


def bm25_search(index: Bm25Index, queries: DataFrame, top_k: int = 10,
                key_cols: list[str] | None = None, text_col: str = "question",
                min_score: int | None = None, tags: list[str] | None = None,
                after_date: str | None = None, fill_zero: bool = True) -> DataFrame:
    """R2: ranked lists (key..., rank, seq, score_micro, score); ``score`` is the
    double of the score rounded to 6 places, ``score_micro`` its integer form."""
    key_cols = key_cols or ["query_id"]
    filtered = min_score is not None or bool(tags) or bool(after_date)
    allowed = doc_filter(index.docs, min_score, tags, after_date) if filtered else index.docs
    docs = None
    if filtered:
        ok = F.exists("attrs", lambda a: lets(lambda c: a[c], min_score, tags, after_date))
        docs = index.scored.where(F.col("seq").isNotNull() & ok)
    parts = match_scores(index, queries, key_cols, text_col, top_k, docs)
    if fill_zero:
        width = top_k + _negative_allowance(index, parts, key_cols)
        fill = (queries.select(*key_cols).crossJoin(F.broadcast(first_docs(allowed, width)))
                .select(*key_cols, F.explode("fill").alias("seq"),
                        F.lit(0).cast("bigint").alias("c")))
        parts = parts.unionByName(fill)
    scores = parts.groupBy(*key_cols, "seq").agg(F.sum("c").alias("nano"))
    micro = F.floor((F.col("nano") + F.lit(500)) / F.lit(1000))
    scores = scores.select(*key_cols, "seq", micro.alias("score_micro"),
                           (micro / F.lit(1e6)).alias("score"))
    w = Window.partitionBy(*key_cols).orderBy(F.col("score_micro").desc(), F.col("seq").asc())
    return (scores.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= top_k))


def with_payload(ranked: DataFrame, docs: DataFrame, cols: list[str]) -> DataFrame:
    """Late materialisation -- attach payload columns after the cut."""
    return ranked.join(docs.select("seq", *cols), "seq")
