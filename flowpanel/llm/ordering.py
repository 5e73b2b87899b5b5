"""Row numbers over a whole table, without a window that holds one key or the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowpanel.llm.common import cut, shuffle_partitions

BUCKET = "_bucket"


def in_ranges(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`df` written in ranges of `order`, with the number of a row's range in the column _bucket.

    Rows that are equal in `order` may be split among ranges next to each other: their place in the
    input comes last in the range key, so no group of equal rows meets in one task.
    """
    n = shuffle_partitions(df.sparkSession)
    placed = df.withColumn("_place", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(n, *order, F.col("_place").asc()).drop("_place")
    return cut(ranged.withColumn(BUCKET, F.spark_partition_id()), name)


def numbered(df: DataFrame, order: list[Column], column: str, name: str) -> DataFrame:
    """`df` with the 1-based number of every row by `order` in `column`.

    Ranges are counted (one row per range), the counts before a range are added to the numbers
    inside it. Rows that are equal in `order` are numbered in no particular order among themselves.
    """
    ranged = in_ranges(df, order, name)
    counts = ranged.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    before = counts.select(BUCKET, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(BUCKET).orderBy(*order))
    out = ranged.withColumn("_inside", inside).join(F.broadcast(before), BUCKET)
    return out.withColumn(column, (F.col("_before") + F.col("_inside")).cast("bigint")).drop(BUCKET, "_inside", "_before")
