"""Row numbers in reading order without a sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_index(df: DataFrame, name: str, *partition: str, ids: str | None = None) -> DataFrame:
    """df with 0, 1, ... in the order of its partitions and their rows (by `partition` columns if given).

    Only one row for each partition meets in a window and is broadcast.  Rows that are
    missing between the `ids` of a partition leave gaps.  The order must be that
    of the source: no shuffle may stand between the read and this call, or `ids`
    names a column that took monotonically_increasing_id before it.
    """
    tagged = df.withColumn("_id", F.col(ids) if ids else F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    if partition:
        counts = tagged.groupBy(*partition, "_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
        w = Window.partitionBy(*partition).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first")).select(*partition, "_part", "_before")
        return tagged.join(F.broadcast(counts), [*partition, "_part"]).withColumn(name, F.col("_id") + F.col("_before")).drop("_id", "_part", "_before")
    counts = tagged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first")).alias("_before"))
    return tagged.join(F.broadcast(counts), "_part").withColumn(name, F.col("_id") + F.col("_before")).drop("_id", "_part", "_before")
