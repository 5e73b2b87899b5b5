"""Backward as-of join as an equi join on time slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A broadcast table of this many intervals stays well below a few hundred MB.
BROADCAST_ROWS = 2_000_000


def _slot(time: str, hours: int, local: bool) -> Column:
    """The slot of a time. Only equality and order of slots matter, so zoned times use epoch hours."""
    if local:
        days = F.datediff(F.to_date(time), F.lit("1970-01-01").cast("date")).cast("bigint")
        return F.floor((days * 24 + F.hour(time)) / hours).cast("bigint")
    return F.floor(F.unix_seconds(time) / (3600 * hours)).cast("bigint")


def asof_backward(
    left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str,
    values: list[str], slot_hours: int = 1, times: DataFrame | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Inner join each left row with the latest right row of its group at or before its time.

    Each right row holds from its time to the next one of its group; the last one holds up to
    the latest left time. The interval is written once per slot it touches, so the join is an
    equi join on (group, slot) that leaves about one candidate per row and spreads a popular
    group over all its slots. Matched measures may be NULL. Rows before the first right row of
    their group are dropped.

    Two small counts come first: the latest left time (from `times`, any table that covers
    `left`, when given) and the number of interval pieces. Only a counted small table is
    broadcast; a larger one is joined by shuffling both sides.
    """
    local = isinstance(left.schema[left_time].dataType, T.TimestampNTZType)
    latest = (times if times is not None else left).agg(F.max(left_time).alias(left_time))
    horizon = F.lit(latest.select(_slot(left_time, slot_hours, local)).first()[0]).cast("bigint")
    spans = (
        right.select(*by, F.col(right_time).alias("_from"), *values)
        .withColumn("_until", F.lead("_from").over(Window.partitionBy(*by).orderBy("_from")))
        .withColumn("_first", _slot("_from", slot_hours, local))
        .withColumn("_last", F.least(F.coalesce(_slot("_until", slot_hours, local), horizon), horizon))
        .where(F.col("_first") <= F.col("_last"))
    )
    pieces = spans.agg(F.sum(F.col("_last") - F.col("_first") + 1)).first()[0] or 0
    held = spans.withColumn("_slot", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
    held = F.broadcast(held) if pieces <= broadcast_rows else held.hint("shuffle_merge")
    rows = left.withColumn("_slot", _slot(left_time, slot_hours, local))
    return (
        rows.join(held, by + ["_slot"])
        .where((F.col(left_time) >= F.col("_from")) & (F.col("_until").isNull() | (F.col(left_time) < F.col("_until"))))
        .drop("_slot", "_from", "_until")
    )
