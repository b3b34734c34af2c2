"""Shared pieces of the training-data operators.

A document frame needs the columns ``doc_id`` (bigint) and ``text`` (string).
Every operator selects the columns it needs by name, so other columns, whatever
their names, cannot clash with its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.session import ensure_checkpoint_dir

#: Characters between words: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Bytes of text that one step of a task handles at a time.
SLICE_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words of a text, in order; none for null or blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder, which all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Folders made inside each open ``scratch``.
_MADE: list[list[str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: the lineage ends at files that outlive executors.

    The files stay for whoever reads the result later; inside ``scratch`` they go with it.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    if _MADE:
        _MADE[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end what ``stored`` wrote inside, also after a failure: use it where the result is written inside, too."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes of text (one row at least)."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array, and the n + 1 ends of its rows (null: empty)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    return flat, offsets - (offsets[0] if len(offsets) else 0)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema,
               limit: int = SLICE_BYTES) -> DataFrame:
    """``fn`` over bounded slices of the Arrow batches; a frame's partitions stay as they are."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, limit=limit):
                yield fn(part)
        # the worker lives on and serves other stages: give back what Arrow keeps for later
        pa.default_memory_pool().release_unused()
    return df.mapInArrow(run, schema)
