"""Positions of rows in their group, without a task that holds a group.

Rows are dealt by ranges of (group, order) and sorted within partitions; the
rows of a group before each partition are counted, so a group that holds a
third of all rows spans as many partitions as its size asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filinglens.session import Scratch


def placed(rows: DataFrame, group: str, order: list[Column], scratch: Scratch) -> DataFrame:
    """``rows`` with ``pos`` (0, 1, ... in the order within the group) and ``n`` (rows of the group).

    ``group`` names a column without nulls. Rows that the order does not tell
    apart take their positions in any order. ``rows`` is read twice (Spark
    samples it for the ranges), so it should be a kept table.
    """
    dealt = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    dealt = scratch.keep(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    starts = dealt.groupBy(group, part).agg(F.min("_at").alias("_lo"), F.count("*").alias("_n"))
    w = Window.partitionBy(group)
    before = F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select(group, "_part", "_lo", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(w).alias("n"))
    found = dealt.withColumn("_part", F.shiftright("_at", 33)).join(starts, [group, "_part"])
    return found.withColumn("pos", F.col("_at") - F.col("_lo") + F.col("_before")).drop("_part", "_lo", "_before", "_at")
