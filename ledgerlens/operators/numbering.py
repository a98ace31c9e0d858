"""Places 1, 2, 3, ... over a whole table, without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.sources.staging import kept

#: Row numbers that Spark gives within a partition, in the lower bits.
_LOW = (1 << 33) - 1


def numbered(rows: DataFrame, *order: str | Column, place: str = "place") -> DataFrame:
    """``rows`` with ``place``, dense from 1 in ``order``, the same on every run.

    The rows are range partitioned, sorted there and staged once with their number in the
    partition; one row for each partition then tells how many come before it. Rows
    that are equal in ``order`` are told apart by a hash of all columns; those equal in
    all of them are interchangeable, and many of them are several partitions' work.
    """
    by = [*order, F.xxhash64(*rows.columns)]
    dealt = rows.repartitionByRange(*by, F.monotonically_increasing_id()).sortWithinPartitions(*by)
    # the number holds the partition, so both are one expression and stand as written
    here = kept(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_at", 33))
    counts = here.groupBy("_part").agg(F.count("*").alias("_n"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = counts.select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    return here.join(F.broadcast(before), "_part").withColumn(place, F.col("_before") + F.col("_at").bitwiseAND(F.lit(_LOW)) + 1).drop("_part", "_at", "_before")


def batched(rows: DataFrame, size: int, *order: str | Column) -> DataFrame:
    """``rows`` with ``batch``, 0, 1, ...: exactly ``size`` rows each but the last, in ``order``."""
    return numbered(rows, *order, place="_place").withColumn("batch", F.floor((F.col("_place") - 1) / size)).drop("_place")
