"""Burst and memory statistics of single series."""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from flowpanel.functions.calendar import elapsed_seconds
from flowpanel.plans.ordered import CHECK, event_starts, over_series, resolve_hot


def autocorrelation(df: DataFrame, lag: int, hot: DataFrame | str | None = CHECK, **split) -> DataFrame:
    """Correlation of usage with itself `lag` rows earlier, per series."""
    def add(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rows.withColumn("_lagged", F.lag("usage", lag).over(w))

    pairs = over_series(df, add, lag, hot=hot, **split).where(F.col("_lagged").isNotNull())
    return pairs.groupBy("series_id").agg(F.corr("usage", "_lagged").alias("autocorr"))


def _with_starts(df: DataFrame, hot: DataFrame | str | None, **split) -> DataFrame:
    return over_series(df, lambda rows, w: rows.withColumn("_start", event_starts("usage", w)), 1, hot=hot, **split)


def burst_stats(df: DataFrame, hot: DataFrame | str | None = CHECK, **split) -> DataFrame:
    """Flow events per series: how many, how often per day, how long, and the highest peak.

    An event starts where flow follows no flow, so events are counted by their starts and need
    no numbering across the series.
    """
    flows = F.col("usage") > 0
    n_events = F.sum(F.when(F.col("_start"), 1).otherwise(0))
    return _with_starts(df, hot, **split).groupBy("series_id").agg(
        n_events.alias("n_events"),
        (n_events / F.count_distinct(F.to_date("date_time"))).alias("events_per_day"),
        (F.sum(F.when(flows, 1).otherwise(0)) / F.nullif(n_events, F.lit(0))).alias("mean_steps"),
        F.max("usage").alias("peak"),
    )


def interarrival(df: DataFrame, hot: DataFrame | str | None = CHECK, **split) -> DataFrame:
    """Minutes between the starts of consecutive flow events of a series."""
    hot = resolve_hot(df, hot, "series_id")
    starts = _with_starts(df, hot, **split).where("_start").select("series_id", "date_time")

    def add(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rows.withColumn("_prev", F.lag("date_time").over(w))

    gaps = over_series(starts, add, 1, hot=hot, **split).where(F.col("_prev").isNotNull())
    minutes = elapsed_seconds(gaps, "date_time", F.col("_prev"), F.col("date_time")) / 60
    return gaps.select("series_id", "date_time", minutes.alias("gap_minutes"))
