"""Token counts of documents, a batch of them at a time.

A task gets texts whose tokens Spark parted by spaces, splits them with Arrow, numbers a run's
distinct tokens once and counts (document, token) pairs with numpy.  No token row is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions.html import plain_spaces

# Tokens that one step of a task counts at a time (one document at least).
STEP_TOKENS = 1 << 18


def token_text(text: Column) -> Column:
    """The tokens of ``bm25_tokens``, parted by spaces: one string a document goes to a task, no array."""
    return plain_spaces(F.lower(text))


def keys_repeat(df: DataFrame, cols: list[str]) -> bool:
    """Whether some key is on several rows (null is a key).  One job over the keys alone."""
    return not df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def token_runs(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """``runs`` of a batch whose ``column`` of ``token_text`` is split, with the empty strings of leading, trailing and
    doubled spaces, which ``token_counts`` leaves out."""
    at = batch.schema.get_field_index(column)
    yield from runs(batch.set_column(at, column, pc.split_pattern(batch.column(at), " ")), column)


def runs(batch: pa.RecordBatch, column: str, limit: int = STEP_TOKENS) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` list entries, or counts of ``compact`` (one row at least)."""
    lists = batch.column(column)
    ends = np.cumsum(counted(lists) if pa.types.is_binary(lists.type) else sizes(lists))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def sizes(lists: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)


def counted(counts: pa.Array) -> np.ndarray:
    """How many counts each row of ``compact`` has."""
    return np.asarray(pc.fill_null(pc.binary_length(counts), 0), dtype=np.int64) // 4


def token_counts(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct tokens, row, token number, count): one entry a row and token, by row; empty tokens are left out."""
    coded = lists.flatten().dictionary_encode()
    words, codes = coded.dictionary, np.asarray(coded.indices, dtype=np.int64)
    rows = np.repeat(np.arange(len(lists)), sizes(lists))
    empty = pc.index(words, "").as_py()
    if empty >= 0:
        rows, codes = rows[codes != empty], codes[codes != empty]
    cells = rows * max(len(words), 1) + codes
    # Numbers of half the size are sorted in half the time.
    small = len(lists) * max(len(words), 1) < 1 << 32
    pairs, n = np.unique(cells.astype(np.uint32) if small else cells, return_counts=True)
    row, code = np.divmod(pairs.astype(np.int64), max(len(words), 1))
    return words, row, code, n


def as_lists(values: pa.Array, rows: np.ndarray, n_rows: int) -> pa.Array:
    """One list a row, of the values whose ``rows`` (ascending) name it."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n_rows))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def compact(words: pa.Array, rows: np.ndarray, codes: np.ndarray, n: np.ndarray, n_rows: int) -> tuple[pa.Array, pa.Array]:
    """A row's tokens as one string, parted by spaces, and their counts as int32 bytes: Spark moves two values a row, not
    two a token."""
    terms = pc.binary_join(as_lists(words.take(pa.array(codes)), rows, n_rows), " ")
    return terms, as_bytes(n.astype(np.int32), rows, n_rows)


def as_bytes(values: np.ndarray, rows: np.ndarray, n_rows: int) -> pa.Array:
    """The bytes of each row's values, whose ``rows`` (ascending) name it."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n_rows))]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), n_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])


def from_bytes(column: pa.Array, kind) -> np.ndarray:
    """The values of all rows of ``as_bytes``, one after the other."""
    data = column.buffers()[2]
    if not data or not len(column):
        return np.zeros(0, kind)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].view(kind)


def expanded(terms: pa.Array, counts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(tokens, count, row) of ``compact`` columns, by row."""
    values = pc.split_pattern(terms, " ").flatten()
    n = counted(counts)
    if not n.all():
        values = values.filter(pc.not_equal(values, ""))   # of rows without a token
    return values, from_bytes(counts, np.int32), np.repeat(np.arange(len(counts)), n)
