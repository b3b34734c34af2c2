"""Total order over rows without gathering a group: range partitions, sorted, numbered and stored.

``numbered`` deals rows by ranges of their order columns, so a group that holds a third
of all rows lies in many partitions; ``_at`` rises with the order through all of
them.  ``positions`` adds each row's place in its group from the groups' counts per
partition, so no task ever reads a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.llm.common import stored

#: Bits of ``_at`` below the partition's number (of ``monotonically_increasing_id``).
PART_BITS = 33


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` sorted by ``order`` (nulls first), with ``_at``; stored, so that ``_at`` stays as it is."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(rows.withColumn("_at", F.monotonically_increasing_id()), name)


def positions(rows: DataFrame, group: str) -> DataFrame:
    """``_pos``, from 0, in the groups of ``group`` (not null), which leads the order of ``numbered`` rows."""
    rows = rows.withColumn("_part", F.shiftright("_at", PART_BITS))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (rows.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
             .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).drop("_n", "_first"))
    return (rows.join(parts, [group, "_part"])
            .withColumn("_pos", F.col("_at") + F.col("_shift")).drop("_part", "_shift", "_at"))
