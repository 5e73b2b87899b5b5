"""Per-series ordered operators that survive a series holding a large share of all rows.

A window partitioned by series puts a whole series into one task. That is the cheapest plan as
long as every series is of ordinary length, so the row count per series is checked first (one
map-side combined count over one column). Series above the bound are cut into buckets of
consecutive rows; each bucket also receives the rows just before it, as many as the operator
looks back. Results are the same on both ways.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from flowpanel.session import materialize

MAX_SERIES_ROWS = 2_000_000
BUCKET_ROWS = 250_000

RN, BUCKET = "_rn", "_bucket"

# The default of every ordered operator: count the rows per series before choosing the plan.
CHECK = "check"


def hot_series(df: DataFrame, key: str = "series_id", max_rows: int = MAX_SERIES_ROWS) -> DataFrame | None:
    """The keys with more than `max_rows` rows, or None when there are none.

    Runs one count. The result is itself a table (at most rows / max_rows keys), so it is never
    collected and Spark picks the join strategy by its size.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.where(F.col("_n") > max_rows).select(key)
    if hot.isEmpty():
        return None
    return materialize(hot, "hot-series")


def resolve_hot(df: DataFrame, hot: DataFrame | str | None, key: str) -> DataFrame | None:
    return hot_series(df, key) if isinstance(hot, str) else hot


def keep_ids(df: DataFrame, ids: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    """Semi (or anti) join that leaves the column order as it was."""
    return df.join(ids, keys, how).select(*[f"`{c}`" for c in df.columns])


def number_rows(df: DataFrame, key: str, time: str) -> DataFrame:
    """Add `_rn`, the 1-based position in time order, with no task larger than one series-day.

    Day counts (combined before they shuffle) give each day its offset; rows are numbered only
    within their day.
    """
    dated = df.withColumn("_day", F.to_date(time))
    counts = dated.groupBy(key, "_day").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    in_day = Window.partitionBy(key, "_day").orderBy(time)
    # NULL times are a day of their own, the first one, as they sort first in the ordinary plan.
    same = dated[key].eqNullSafe(offsets[key]) & dated["_day"].eqNullSafe(offsets["_day"])
    return (
        dated.join(offsets, same).drop(offsets[key]).drop(offsets["_day"])
        .withColumn(RN, F.col("_offset") + F.row_number().over(in_day))
        .drop("_day", "_offset")
    )


def _bucketed(
    df: DataFrame, add: Callable[[DataFrame, WindowSpec], DataFrame],
    lookback: int, key: str, time: str, bucket_rows: int,
) -> DataFrame:
    size = max(bucket_rows, lookback + 1)
    pos = F.col(RN) - 1
    own = F.floor(pos / size)
    feeds_next = (pos % size) >= (size - lookback)
    rows = (
        number_rows(df, key, time)
        .withColumn(BUCKET, F.explode(F.when(feeds_next, F.array(own, own + 1)).otherwise(F.array(own))))
    )
    done = add(rows, Window.partitionBy(key, BUCKET).orderBy(RN))
    return done.where(F.col(BUCKET) == F.floor((F.col(RN) - 1) / size)).drop(BUCKET, RN)


def over_series(
    df: DataFrame, add: Callable[[DataFrame, WindowSpec], DataFrame], lookback: int,
    key: str = "series_id", time: str = "date_time",
    hot: DataFrame | str | None = CHECK, bucket_rows: int | None = None,
) -> DataFrame:
    """Apply `add(rows, window)`, whose frames reach at most `lookback` rows back.

    `add` must keep all input columns. The long series are looked up first, unless the caller
    passes the result of `hot_series` on a table that covers `df` (None: there are none).
    """
    hot = resolve_hot(df, hot, key)
    series_window = Window.partitionBy(key).orderBy(time)
    if hot is None:
        return add(df, series_window)
    df = materialize(df, "ordered-input")  # both plans and the counts read it; its lineage runs once
    cold = add(keep_ids(df, hot, [key], "left_anti"), series_window)
    split = _bucketed(keep_ids(df, hot, [key]), add, lookback, key, time, bucket_rows or BUCKET_ROWS)
    return cold.unionByName(split)


def event_starts(value: str, window: WindowSpec, threshold: float = 0.0) -> Column:
    """True where `value` rises above `threshold` after a row (or the series start) at or below it."""
    flows = F.col(value) > threshold
    return flows & ~F.coalesce(F.lag(flows).over(window), F.lit(False))
