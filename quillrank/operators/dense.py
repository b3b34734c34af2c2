"""Dense retrieval.

Exact cosine top-k of every query against every document vector -- what the
reference's embedded vector store does by brute force.  Both sides are packed
into blocks, one row a block with its vectors as one matrix, and every block of
queries meets every block of documents in a join on the query block's number
(queries stay on the executors, whatever their number).  A task multiplies the
two matrices with numpy (one BLAS call) and emits, per query, the block's k
best, ties cut by document position.  The cut over blocks is a window top-k
(WindowGroupLimit, partial before its shuffle) on the score rounded to 6 places.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from quillrank.functions.text import bm25_tokens
from quillrank.operators.counting import as_bytes, as_lists, from_bytes, keys_repeat, sizes, token_runs, token_text
from quillrank.operators.util import BROADCAST_MAX_BYTES, materialize

# Cells (rows x dimensions) of a block's matrix, about: 2 MB of doubles.
BLOCK_CELLS = 1 << 18
# Cells (documents x dimensions) that the embedder counts in one array at most; 8 MB.
COUNTED_CELLS = 1 << 20
# Default embedder (hashed bag of words) dimension.
HASH_DIM = 384
SCORE_OUT = "decimal(18,6)"
# Columns of a query's own filter, and those of a document that it looks at.
QUERY_FILTERS = ["min_vote_score", "tags", "after_date"]
DOC_FILTERS = ["question_score", "tags_list", "creation_date"]


# --- M1: deterministic default embedder ------------------------------------

def hash_buckets(df: DataFrame, key_cols: list[str], text_col: str,
                 dim: int = HASH_DIM) -> DataFrame:
    """Sparse hashed bag of words: (key..., bucket, cnt).

    bucket = first 6 hex digits of md5(lower-cased token) mod ``dim``.
    """
    tok = F.explode(bm25_tokens(F.col(text_col))).alias("tok")
    bucket = (F.conv(F.substring(F.md5(F.col("tok")), 1, 6), 16, 10).cast("int") % dim)
    return (df.select(*key_cols, tok).select(*key_cols, bucket.alias("bucket"))
            .groupBy(*key_cols, "bucket").agg(F.count(F.lit(1)).cast("int").alias("cnt")))


# MD5 (RFC 1321): the added constant and the rotation of each step.
MD5_ADDED = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0 ** 32).astype(np.uint32)
MD5_TURNS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32).repeat(4, axis=0).reshape(64)
# Tokens hashed at a time, so that their numbers stay in a core's cache, and the bytes of those that fit one block of MD5.
HASHED_TOKENS, ONE_BLOCK = 1 << 15, 55


def _md5_heads(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of each token of ONE_BLOCK bytes at most (the others' are of no use)."""
    n = np.diff(ends)
    n[n > ONE_BLOCK] = 0
    words = np.zeros((16, len(n)), np.uint32)
    for i in range(int(n.max(initial=0)) + 1):   # the i-th byte of each token, or the bit that follows the last one
        byte = np.where(i < n, data.take(ends[:-1] + i, mode="clip") if len(data) else 0, np.where(i == n, 0x80, 0))
        words[i // 4] |= byte.astype(np.uint32) << np.uint32(i % 4 * 8)
    words[14] = n * 8
    start = [np.uint32(x) for x in (0x67452301, 0xefcdab89, 0x98badcfe, 0x10325476)]
    a, b, c, d = (np.full(len(n), x) for x in start)
    for i in range(64):
        if i < 16:
            mixed, word = d ^ (b & (c ^ d)), i
        elif i < 32:
            mixed, word = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            mixed, word = b ^ c ^ d, (3 * i + 5) % 16
        else:
            mixed, word = c ^ (b | ~d), 7 * i % 16
        mixed += a
        mixed += words[word]
        mixed += MD5_ADDED[i]
        a, d, c, b = d, c, b, b + ((mixed << MD5_TURNS[i]) | (mixed >> (np.uint32(32) - MD5_TURNS[i])))
    return a + start[0]


def _buckets(tokens: pa.Array, dim: int) -> np.ndarray:
    """Each token's bucket as in ``hash_buckets``; the empty string is no token and gets -1."""
    found = tokens.cast(pa.binary())
    _, ends, data = found.buffers()
    ends = np.frombuffer(ends, np.int32)[found.offset:found.offset + len(found) + 1] if len(found) else np.zeros(1, np.int32)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    head = np.concatenate([np.zeros(0, np.uint32), *(_md5_heads(data, ends[at:at + HASHED_TOKENS + 1])
                                                     for at in range(0, len(found), HASHED_TOKENS))])
    for i in np.flatnonzero(np.diff(ends) > ONE_BLOCK).tolist():
        head[i] = int.from_bytes(md5(data[ends[i]:ends[i + 1]]).digest()[:4], "little")
    # the first six hex digits: the first three bytes, the first one highest
    out = (head.byteswap() >> np.uint32(8)).astype(np.int64) % dim
    empty = pc.index(tokens, "").as_py()
    if empty >= 0:
        out[empty] = -1
    return out


def _cell_counts(cells: np.ndarray, n: int, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct cells of ``n``, ascending; how often each is there, an entry counting ``times``)."""
    if n > COUNTED_CELLS:
        held, at = np.unique(cells, return_inverse=True)
        return held, np.bincount(at, times, len(held)).astype(np.int64)
    counts = np.bincount(cells, times, n)
    held = np.flatnonzero(counts)
    return held, counts[held].astype(np.int64)


def embed_counts(counted: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]], n_rows: int,
                 dim: int = HASH_DIM) -> tuple[pa.Array, pa.Array]:
    """``hash_embed`` of rows whose tokens are counted already (``token_counts``, of several texts a row): the vectors'
    (idx, val) as bytes, which Spark moves as two values a row.  A row without a token has none."""
    cells = np.concatenate([row * dim + _buckets(words, dim)[code] for words, row, code, _ in counted])
    cells, val = _cell_counts(cells, n_rows * dim, np.concatenate([n for *_, n in counted]))
    row, idx = cells // dim, cells % dim
    return as_bytes(idx.astype(np.uint16), row, n_rows), as_bytes(val.astype(np.int32), row, n_rows)


def hash_embed(df: DataFrame, key_cols: list[str], text_col: str,
               dim: int = HASH_DIM) -> DataFrame:
    """Sparse count vectors (key..., embedding struct<idx, val>) of the hashed
    bag of words, one row per key that has a token (at most ``dim`` entries).  Counts are kept
    unnormalised: integer-valued vectors make every dot product exact, and
    cosine divides by the norms afterwards.  The search densifies blocks in
    numpy, where that is a single scatter.

    A row is counted where it lies; only where keys repeat, the rows of a key are added up after a shuffle."""
    rows = df.select(*key_cols, token_text(F.col(text_col)).alias("_toks"))

    def run(batches):
        for batch in batches:
            for part in token_runs(batch, "_toks"):
                lists = part.column("_toks")
                coded = lists.flatten().dictionary_encode()
                bucket = _buckets(coded.dictionary, dim)[np.asarray(coded.indices, dtype=np.int64)]
                row = np.repeat(np.arange(part.num_rows), sizes(lists))
                cells, val = _cell_counts((row * dim + bucket)[bucket >= 0], part.num_rows * dim)
                row, idx = cells // dim, cells % dim
                held = np.unique(row)
                row = np.searchsorted(held, row)
                vectors = pa.StructArray.from_arrays(
                    [as_lists(pa.array(idx, pa.int32()), row, len(held)), as_lists(pa.array(val.astype(np.float64)), row, len(held)),
                     pa.array(np.full(len(held), dim), pa.int32())], ["idx", "val", "dim"])
                keys = [part.column(i).take(pa.array(held)) for i in range(len(key_cols))]
                yield pa.RecordBatch.from_arrays([*keys, vectors], [*key_cols, "embedding"])

    vector = StructType([StructField("idx", ArrayType(IntegerType())), StructField("val", ArrayType(DoubleType())),
                         StructField("dim", IntegerType())])
    counted = rows.mapInArrow(run, StructType([*(rows.schema[c] for c in key_cols), StructField("embedding", vector)]))
    if not keys_repeat(df, key_cols):
        return counted
    cells = (counted.select(*key_cols, F.explode(F.arrays_zip("embedding.idx", "embedding.val")).alias("e"))
             .groupBy(*key_cols, F.col("e.idx").alias("idx")).agg(F.sum("e.val").alias("val")))
    return cells.groupBy(*key_cols).agg(F.array_sort(F.collect_list(F.struct("idx", "val"))).alias("e")).select(
        *key_cols, F.struct(F.col("e.idx").alias("idx"), F.col("e.val").alias("val"), F.lit(dim).alias("dim")).alias("embedding"))


def to_matrix(col: pa.Array) -> np.ndarray:
    """Vectors of an Arrow column, dense arrays or sparse struct<idx, val, dim> (lists, or the bytes of
    ``embed_counts``), as a float64 matrix; null is 0."""
    if not pa.types.is_struct(col.type):
        flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        sizes = np.asarray(pc.fill_null(pc.list_value_length(col), 0))
        dim = int(sizes.max(initial=0))
        if (sizes[sizes > 0] != dim).any():
            raise ValueError("vectors of different lengths")
        out = np.zeros((len(col), dim))
        out[sizes > 0] = np.nan_to_num(flat).reshape(-1, dim) if dim else 0.0
        return out
    dims = np.asarray(pc.fill_null(col.field("dim"), 0))
    out = np.zeros((len(col), int(dims.max(initial=0))))
    idx, val = col.field("idx"), col.field("val")
    if pa.types.is_binary(idx.type):
        n = np.asarray(pc.fill_null(pc.binary_length(idx), 0), dtype=np.int64) // 2
        out[np.repeat(np.arange(len(col)), n), from_bytes(idx, np.uint16)] = from_bytes(val, np.int32)
        return out
    rows = np.repeat(np.arange(len(col)), np.asarray(pc.fill_null(pc.list_value_length(idx), 0)))
    out[rows, idx.flatten().to_numpy(zero_copy_only=False)] = val.flatten().to_numpy(zero_copy_only=False)
    return out


# --- R4: exact cosine top-k -------------------------------------------------

def _micro(cos: np.ndarray) -> np.ndarray:
    """Scores as whole millionths, rounded half up in decimal as SCORE_OUT does."""
    values, at = np.unique(cos, return_inverse=True)
    return np.array([int(Decimal(repr(v)).scaleb(6).to_integral_value(ROUND_HALF_UP)) for v in values.tolist()],
                    dtype=np.int64)[at]


def allowed(docs: pa.Table, filters: pa.Table) -> np.ndarray:
    """Documents x queries: whether a query's own filter lets the document through."""
    def of(table, name, empty):
        return np.asarray(pc.fill_null(table.column(name), empty).to_numpy(zero_copy_only=False))

    ok = of(docs, "question_score", 0).astype(np.float64)[:, None] >= of(filters, "min_vote_score", 0).astype(np.float64)[None, :]
    ok &= of(docs, "creation_date", "").astype(str)[:, None] >= of(filters, "after_date", "").astype(str)[None, :]
    wanted = [frozenset(t or ()) for t in filters.column("tags").to_pylist()]
    held = [set(t or ()) for t in docs.column("tags_list").to_pylist()]
    for tags in set(wanted) - {frozenset()}:   # one pass a distinct tag set
        cols = np.array([w == tags for w in wanted])
        ok[:, cols] &= np.array([not tags.isdisjoint(h) for h in held])[:, None]
    return ok


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: pa.Buffer) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _block(table: pa.Table, vec_col: str) -> tuple[bytes, bytes, int]:
    """A block's other columns, its matrix as bytes, and the matrix's width."""
    column = table.column(vec_col).combine_chunks()
    m = to_matrix(pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column)
    return packed(table.drop_columns([vec_col]).combine_chunks()), m.tobytes(), m.shape[1]


def document_blocks(docs: DataFrame, vec_col: str, rows: int) -> DataFrame:
    """keys, matrix, dim: runs of up to ``rows`` rows of a partition, without a shuffle."""
    def run(batches):
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, rows - n)
                held.append(part)
                n += part.num_rows
                at += part.num_rows
                if n == rows:
                    yield _rows([_block(pa.Table.from_batches(held), vec_col)])
                    held, n = [], 0
        if held:
            yield _rows([_block(pa.Table.from_batches(held), vec_col)])

    return docs.mapInArrow(run, "keys binary, matrix binary, dim int")


def _rows(found: list) -> pa.RecordBatch:
    keys, matrix, dim = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(matrix, pa.binary()), pa.array(dim, pa.int32())],
                                      ["keys", "matrix", "dim"])


def query_blocks(queries: DataFrame, key_cols: list[str], vec_col: str, blocks: int) -> DataFrame:
    """block, q_keys, q_matrix, q_dim: the queries dealt over ``blocks`` by a hash of key and vector."""
    dealt = queries.withColumn("block", F.pmod(F.xxhash64(*key_cols, vec_col), F.lit(blocks)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        number = table.column("block")[0].as_py()
        keys, matrix, dim = _block(table.drop_columns(["block"]), vec_col)
        return pa.table({"block": pa.array([number], pa.int32()), "q_keys": pa.array([keys], pa.binary()),
                         "q_matrix": pa.array([matrix], pa.binary()), "q_dim": pa.array([dim], pa.int32())})

    return dealt.groupBy("block").applyInArrow(run, "block int, q_keys binary, q_matrix binary, q_dim int")


def cut(score: np.ndarray, order: np.ndarray, k: int, margin: float = 0.0, rounded=None,
        floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, query) places of each query's k best scores, ties by ``order``; -inf is no match.  ``rounded`` gives
    the scores to rank by, which differ by less than ``margin``.  ``floor`` holds for each query a score that k
    documents of earlier blocks reach: what is below it is left out, and it is raised."""
    n = len(score)
    kth = np.partition(score, n - k, axis=0)[n - k] if n >= k else np.full(score.shape[1], -np.inf)
    if floor is not None:
        kth = np.maximum(floor, kth, out=floor)
    rows, cols = np.nonzero((score >= (kth - margin)[None, :]) & np.isfinite(score))
    found = score[rows, cols]
    rank = np.lexsort((order[rows], -(rounded(found) if rounded else found), cols))
    rows, cols = rows[rank], cols[rank]
    start = np.flatnonzero(np.concatenate([[True], cols[1:] != cols[:-1]])) if len(cols) else np.zeros(0, int)
    place = np.arange(len(cols)) - np.repeat(start, np.diff(np.append(start, len(cols))))
    return rows[place < k], cols[place < k]


def _best(cos: np.ndarray, order: np.ndarray, k: int, margin: float = 1e-6,
          floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, query) places of each query's k best by rounded score, ties by ``order``; -inf is no match."""
    return cut(cos, order, k, margin, _micro, floor)


def _cosines(dmat: np.ndarray, qmat: np.ndarray) -> np.ndarray:
    norms = np.sqrt((dmat * dmat).sum(axis=1))[:, None] * np.sqrt((qmat * qmat).sum(axis=1))[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norms > 0, (dmat @ qmat.T) / norms, 0.0)


def _meet(doc_key: str, key_cols: list[str], k: int, filtered: bool):
    """Each pair of a document and a query block: its k best documents of every query."""
    def run(batches):
        raw, floor = None, None
        for batch in batches:
            keys, matrix, dim, q_keys, q_matrix, q_dim = batch.columns
            for i in range(batch.num_rows):
                docs, queries = unpacked(keys[i].as_buffer()), unpacked(q_keys[i].as_buffer())
                dmat = np.frombuffer(matrix[i].as_buffer()).reshape(docs.num_rows, dim[i].as_py())
                qmat = np.frombuffer(q_matrix[i].as_buffer()).reshape(queries.num_rows, q_dim[i].as_py())
                if not (dmat.size and qmat.size):   # nothing but null vectors on a side
                    dmat, qmat = np.zeros((docs.num_rows, 1)), np.zeros((queries.num_rows, 1))
                cos = _cosines(dmat, qmat)
                if filtered:
                    cos = np.where(allowed(docs, queries), cos, -np.inf)
                if raw is None or not raw.equals(q_keys[i].as_buffer()):
                    raw, floor = q_keys[i].as_buffer(), np.full(queries.num_rows, -np.inf)
                at, of = _best(cos, np.unique(docs.column(doc_key).to_numpy(), return_inverse=True)[1], k, floor=floor)
                if len(at):
                    found = docs.select([doc_key]).take(pa.array(at)).append_column("cos", pa.array(cos[at, of]))
                    for c in key_cols:
                        found = found.append_column(c, queries.column(c).take(pa.array(of)))
                    yield from found.combine_chunks().to_batches()
    return run


def dense_search(docs: DataFrame, queries: DataFrame, top_k: int = 10,
                 doc_key: str = "seq", key_cols: list[str] | None = None,
                 vec_col: str = "embedding", per_query_filters: bool = False, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """(key..., rank, seq, score) by cosine, score DECIMAL(18,6).

    With ``per_query_filters`` each query has ``min_vote_score``, ``tags`` and ``after_date``, and the documents
    ``question_score``, ``tags_list`` and ``creation_date`` (F8, applied before the cut)."""
    fcols = QUERY_FILTERS if per_query_filters else []
    dcols = DOC_FILTERS if per_query_filters else []
    key_cols = key_cols or ["query_id"]
    q = materialize(queries.select(*key_cols, vec_col, *fcols))
    size = F.col(f"{vec_col}.dim") if isinstance(q.schema[vec_col].dataType, StructType) else F.size(vec_col)
    others = F.sum(F.octet_length(F.to_json(F.struct(*key_cols, *fcols))).cast("bigint"))
    n_q, dim, n_bytes = q.agg(F.count(F.lit(1)), F.coalesce(F.max(size), F.lit(1)), F.coalesce(others, F.lit(0))).first()
    per_block = max(1, block_cells // max(dim, 1))
    n_blocks = max(1, -(-n_q // per_block))
    blocks = query_blocks(q, key_cols, vec_col, n_blocks)
    # A query side within the bound goes to every task, and documents stay where they are.
    blocks = F.broadcast(blocks) if 8 * n_q * dim + n_bytes <= BROADCAST_MAX_BYTES else blocks
    grid = document_blocks(docs.select(doc_key, vec_col, *dcols), vec_col, per_block)
    grid = grid.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(blocks, "block")
    schema = StructType([docs.schema[doc_key], StructField("cos", DoubleType()), *(q.schema[c] for c in key_cols)])
    met = grid.select("keys", "matrix", "dim", "q_keys", "q_matrix", "q_dim").mapInArrow(
        _meet(doc_key, key_cols, top_k, per_query_filters), schema)
    scored = met.select(*key_cols, doc_key, F.col("cos").cast(SCORE_OUT).alias("score"))
    w = Window.partitionBy(*key_cols).orderBy(F.col("score").desc(), F.col(doc_key).asc())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def sparse_cosine(left: DataFrame, right: DataFrame, pair: DataFrame,
                  lkey: str, rkey: str) -> DataFrame:
    """Cosine of sparse hashed vectors for given (lkey, rkey) pairs.

    ``left``/``right`` are (key, bucket, cnt) tables; the dot product is an
    equi-join on (pair, bucket), so only the pairs asked for are computed.
    """
    ln = left.groupBy(lkey).agg(F.sqrt(F.sum(F.col("cnt") * F.col("cnt")).cast("double"))
                                .alias("ln"))
    rn = right.groupBy(rkey).agg(F.sqrt(F.sum(F.col("cnt") * F.col("cnt")).cast("double"))
                                 .alias("rn"))
    l2 = left.withColumnRenamed("cnt", "lc")
    r2 = right.withColumnRenamed("cnt", "rc")
    dots = (pair.join(l2, lkey).join(r2, [rkey, "bucket"])
            .groupBy(lkey, rkey).agg(F.sum(F.col("lc") * F.col("rc")).alias("dot")))
    out = (pair.join(dots, [lkey, rkey], "left").join(ln, lkey, "left").join(rn, rkey, "left"))
    cos = F.when(F.col("ln") * F.col("rn") > 0,
                 F.coalesce(F.col("dot"), F.lit(0)).cast("double") / (F.col("ln") * F.col("rn"))
                 ).otherwise(F.lit(0.0))
    return out.select(lkey, rkey, cos.alias("cos"))
