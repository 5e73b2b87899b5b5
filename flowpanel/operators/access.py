"""Lazy panel queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowpanel.functions.calendar import instant_literal, year_range
from flowpanel.plans.ordered import keep_ids

IN_LIST_LIMIT = 1000


def get_meter_data(panel: DataFrame, meter_id: str, time: str = "date_time") -> DataFrame:
    return panel.where(F.col("meter_id") == meter_id).orderBy(time)


def _between(panel: DataFrame, start, end, time: str) -> DataFrame:
    return panel.where(
        (F.col(time) >= instant_literal(panel, time, start)) & (F.col(time) <= instant_literal(panel, time, end))
    )


def get_time_range(panel: DataFrame, start, end, time: str = "date_time") -> DataFrame:
    """All meters between two times, both included; text is read in the session zone."""
    return _between(panel, start, end, time).orderBy("meter_id", time)


def get_panel_subset(panel: DataFrame, meter_ids, start, end, time: str = "date_time") -> DataFrame:
    """Chosen meters in a time range. Short lists become a pushed-down IN, long ones (or a
    DataFrame of ids) a semi join."""
    rows = _between(panel, start, end, time)
    if isinstance(meter_ids, DataFrame):
        rows = keep_ids(rows, meter_ids.select("meter_id"), ["meter_id"])
    elif len(meter_ids) <= IN_LIST_LIMIT:
        rows = rows.where(F.col("meter_id").isin(list(meter_ids)))
    else:
        ids = panel.sparkSession.createDataFrame([(i,) for i in meter_ids], "meter_id string")
        rows = keep_ids(rows, ids, ["meter_id"])
    return rows.orderBy("meter_id", time)


def filter_years(panel: DataFrame, first: int = 2023, last: int = 2024, time: str = "date_time") -> DataFrame:
    return panel.where(year_range(panel, time, first, last))


def high_usage_events(panel: DataFrame, min_temp: float = 30.0, min_usage: float = 10.0) -> DataFrame:
    return panel.where((F.col("temp_c") > min_temp) & (F.col("usage") > min_usage))


def filter_doy(df: DataFrame, day: int, time: str = "time") -> DataFrame:
    return df.where(F.dayofyear(time) == day)


def nonzero_usage(df: DataFrame, usage: str = "usage") -> DataFrame:
    """Positive usage. NaN counts as larger than any number in Spark, so it is excluded first."""
    return df.where(~F.isnan(usage) & (F.col(usage) > 0))


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows with NULL or NaN in any column."""
    return df.na.drop("any")


def order_panel(panel: DataFrame, time: str = "date_time") -> DataFrame:
    """Global order by series and time, for a final sink; a range sort, not one task."""
    return panel.orderBy("series_id", time)


def semi_join_ids(df: DataFrame, ids: DataFrame, keys: tuple[str, ...] = ("source", "home_id")) -> DataFrame:
    return keep_ids(df, ids, list(keys))
