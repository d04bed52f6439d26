"""Row numbers over a whole table without a single-task window."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbered_rows(rows: DataFrame, order_by: list[str | Column], name: str = "row_no") -> DataFrame:
    """Rows with their number from 1 in the given order. Rows are dealt by range; a partition's first
    number comes from the totals of those before it (one driver row for each partition)."""
    order = [F.col(o) if isinstance(o, str) else o for o in order_by]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    part = F.spark_partition_id()
    dealt = dealt.withColumn("_part", part).withColumn("_row", F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)).persist(StorageLevel.MEMORY_AND_DISK)
    starts, at = [], 0
    for r in dealt.groupBy("_part").count().orderBy("_part").collect():
        starts.append((r["_part"], at))
        at += r["count"]
    first = rows.sparkSession.createDataFrame(starts, "_part int, _start long")
    return dealt.join(F.broadcast(first), "_part").withColumn(name, F.col("_start") + F.col("_row") + 1).drop("_part", "_row", "_start")
