"""Numbering all rows in one order without sending them through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procweave.operators.graph import cut


def global_row_number(df: DataFrame, value: str, ties: list[str], descending: bool = True, into: str = "row_num") -> DataFrame:
    """Number rows from 1 by a column (nulls last), ties in the given order.

    Rows are dealt by ranges of the value and the ties together, so a value that many rows share fills many ranges. Each
    range is numbered by itself and moved up by the number of rows in the ranges before it. The dealt rows are written
    once, so a range keeps its rows whatever is lost later.
    """
    order = [F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last(), *[F.col(t).asc() for t in ties]]
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    # One row a range: bounded by the number of shuffle partitions.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_range"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_range").orderBy(*order)
    numbered = ranged.join(F.broadcast(starts), "_range").withColumn(into, F.row_number().over(within) + F.col("_start"))
    return numbered.drop("_range", "_start").withColumn(into, F.col(into).cast("long"))
