"""Work along the order of a table's values, in ranges: no task orders more than its range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import stored


def in_ranges(df: DataFrame, value: str) -> DataFrame:
    """df with ``_part``, the number of the range of values that a row lies in; written, so that every use sees the same ranges."""
    return stored(df.repartitionByRange(F.col(value)).withColumn("_part", F.spark_partition_id()), "ranges")


def running_totals(df: DataFrame, value: str, amount: str) -> DataFrame:
    """df (one row per value) with ``_up_to``, the sum of amount up to and with the row's value, and ``_all``, that of all rows."""
    ranged = in_ranges(df, value)
    parts = ranged.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    parts = parts.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.sum("_sum").over(Window.partitionBy()).alias("_all"))
    own = F.sum(amount).over(Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_own", own).join(parts, "_part").withColumn("_up_to", F.col("_before") + F.col("_own")).drop("_own", "_before", "_part")


def with_neighbours(df: DataFrame, value: str, amount: str) -> DataFrame:
    """df (one row per value) with ``_rank`` from 1, ``_next``, the following value, and ``_last`` and ``_last_n``, the value and amount before; null at the ends."""
    ranged = in_ranges(df, value)
    ends = F.struct(F.col(value).alias("v"), F.col(amount).alias("n"))
    parts = ranged.groupBy("_part").agg(F.min(ends).alias("_first"), F.max(ends).alias("_end"), F.count("*").alias("_count"))
    order = Window.orderBy("_part")  # one row per range
    parts = parts.select(
        "_part", F.lead("_first").over(order).alias("_after"), F.lag("_end").over(order).alias("_ahead"),
        F.coalesce(F.sum("_count").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    own = Window.partitionBy("_part").orderBy(value)
    rows = ranged.withColumns({"_i": F.row_number().over(own), "_to": F.lead(value).over(own), "_from": F.lag(ends).over(own)}).join(parts, "_part")
    near = F.coalesce("_from", "_ahead")
    return rows.select(value, amount, (F.col("_before") + F.col("_i")).alias("_rank"), F.coalesce("_to", "_after.v").alias("_next"), near["v"].alias("_last"), near["n"].alias("_last_n"))
