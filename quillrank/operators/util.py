"""Small plan helpers shared by the operators."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.session import ensure_checkpoint_dir

log = logging.getLogger(__name__)

# Largest query-side frame (bytes as JSON text) that is shipped to every task.
# Query sides are batches of questions or their terms; beyond this they are shuffled.
BROADCAST_MAX_BYTES = 64 << 20


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Whether the rows of ``df``, measured in one aggregate, stay within the bound."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("bigint"))).first()[0]
    return (size or 0) <= max_bytes


def maybe_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``df`` only after measuring it; above the bound, leave the join
    to a shuffle (sort-merge, with AQE's skew split)."""
    return F.broadcast(df) if fits_broadcast(df, max_bytes) else df


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back.

    A frame read by several branches of one plan is otherwise computed by each
    of the concurrent jobs that broadcast or shuffle those branches.  The files
    outlive executors, and the plans above start at a scan: cached frames would
    carry all that made them (the HTML cleaning's long expressions) through
    every later analysis."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/held-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def isolated(name: str, build: Callable[[], DataFrame], schema: str) -> tuple[DataFrame, str | None]:
    """The rows of ``build()``, written, and no error; where building or running it fails, no rows of
    ``schema`` and the error's text, which is logged, too.  Other parts of a batch go on without it."""
    try:
        return materialize(build()), None
    except (PySparkException, Py4JError) as e:
        log.error("%s failed: %s", name, e)
        return SparkSession.getActiveSession().createDataFrame([], schema), f"{type(e).__name__}: {e}"


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition ``df`` by ``cols`` when its scan yields fewer partitions
    than the cluster can run at once (e.g. one large row group).

    Text work is CPU-bound; one task per file would serialise it.  A scan that
    already splits into enough tasks is left alone -- no extra shuffle of raw
    text at scale.  Partitioning by the document key also lets a later
    aggregation keyed by (key, ...) run without another exchange.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, *cols)
