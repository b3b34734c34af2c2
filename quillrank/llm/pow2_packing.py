"""Packing by power-of-two decomposition.

Each document's ids are cut along the binary expansion of their number: whole
sequences of ``max_len`` first, then the powers of two of the rest, descending.
A piece is a sequence of its own, so no sequence crosses documents and none
needs padding; equal lengths share a bucket (``bucket`` = log2 of the length).

Defined cases: a null or empty text has the end id alone; repeated rows are
packed once each; a null ``doc_id`` stays null; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import map_slices
from quillrank.llm.tokens import WordTokenizer, default_path

MAX_LEN = 4096
END_ID = 2
_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, bucket int"


def binary_lengths(total: int, max_len: int = MAX_LEN) -> list[int]:
    """The pieces of ``total`` ids: multiples of max_len (a power of two), then the set bits of the rest."""
    full, rest = divmod(total, max_len)
    return [max_len] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, path: str | None = None, max_len: int = MAX_LEN, end_id: int = END_ID,
         ids: bool = True) -> DataFrame:
    """One row per sequence, with its ids as an int array unless ``ids`` is off (the digests stay)."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    path = path or default_path()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, ends = WordTokenizer.open(path).encode(batch.column("text"))
        out: list[list] = [[], [], [], [], [], []]
        arrays: list[np.ndarray] = []
        for doc, a, b in zip(batch.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
            own = np.append(flat[a:b], np.uint32(end_id)).astype("<u4")
            start = 0
            for n in binary_lengths(len(own), max_len):
                piece = own[start:start + n]
                for column, x in zip(out, (doc, start, n, zlib.crc32(piece), len(own), n.bit_length() - 1)):
                    column.append(x)
                if ids:
                    arrays.append(piece)
                start += n
        columns = [pa.array(x, pa.int32() if i == 5 else pa.int64()) for i, x in enumerate(out)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket"]
        if ids:
            at = np.concatenate([[0], np.cumsum(out[2])]).astype(np.int32)
            values = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(values)))
            names.append("input_ids")
        return pa.RecordBatch.from_arrays(columns, names)

    cut_rows = map_slices(docs.select("doc_id", "text"), cut, _SCHEMA + (", input_ids array<int>" if ids else ""))
    return cut_rows.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per length, so that a reader draws batches of one shape."""
    packed.write.partitionBy("bucket").parquet(path)


def op8(spark, sf_dir):
    from quillrank.llm.common import documents
    return pack(documents(spark, sf_dir), ids=False)
