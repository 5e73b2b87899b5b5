"""From readings to the enriched panel: locations and weather."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowpanel.plans.asof import BROADCAST_ROWS, asof_backward
from flowpanel.session import materialize

MEASURES = ["temp_c", "precip_mm", "snow_cm"]


def drop_unlocated(df: DataFrame) -> DataFrame:
    return df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def join_locations(
    readings: DataFrame, locations: DataFrame, key: str = "meter_id", broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Inner join on the 10-character meter id. A meter with two locations doubles its readings.

    The located meters are counted: up to the bound they are broadcast, so the readings stay where they are. Of more
    meters those with readings are counted again. Beyond the bound nothing is asked for: Spark shuffles both sides
    (adaptive execution then splits a hot meter).
    """
    places = drop_unlocated(locations)
    if places.limit(broadcast_rows + 1).count() > broadcast_rows:
        places = materialize(places.join(readings.select(key).distinct(), key, "left_semi"), "places")
        if places.limit(broadcast_rows + 1).count() > broadcast_rows:
            return readings.join(places, key)
    return readings.join(F.broadcast(places), key)


def asof_weather(
    usage: DataFrame, weather: DataFrame, by: list[str], usage_time: str = "date_time",
    weather_time: str = "wx_time", measures: list[str] | None = None, times: DataFrame | None = None,
) -> DataFrame:
    """Backward, inner as-of join with the weather of the same place."""
    return asof_backward(usage, weather, by, usage_time, weather_time, measures or MEASURES, times=times)


def grid_keys(lat: str = "lat", lon: str = "lon", digits: int = 4) -> list[Column]:
    return [F.round(lat, digits).alias("lat_key"), F.round(lon, digits).alias("lon_key")]


def grid_key_text(lat: str = "lat", lon: str = "lon", start: str | None = None, end: str | None = None) -> Column:
    """The cache key of a rounded location (and date range) with `p` for the decimal point.

    A whole number has no decimal point: 40, not 40p0.
    """
    def part(c: str) -> Column:
        plain = F.regexp_replace(F.round(c, 4).cast("string"), "\\.0$", "")
        return F.regexp_replace(plain, "\\.", "p")

    key = F.format_string("lat_%s_lon_%s", part(lat), part(lon))
    if start and end:
        return F.concat_ws("_", key, F.col(start).cast("string"), F.col(end).cast("string"))
    return key


def weather_request_plan(
    located: DataFrame, key: str = "series_id", time: str = "date_time",
    request_by: tuple[str, ...] = ("lat_key", "lon_key"),
) -> DataFrame:
    """The distinct weather requests: rounded location and the date range of each series there."""
    per_series = located.groupBy(key).agg(
        F.to_date(F.min(time)).alias("start_date"),
        F.to_date(F.max(time)).alias("end_date"),
        F.min_by(F.struct("lat", "lon"), F.col(time)).alias("_at"),
    )
    return per_series.select(
        *grid_keys("_at.lat", "_at.lon"), "start_date", "end_date"
    ).groupBy(*request_by, "start_date", "end_date").agg(F.count(F.lit(1)).alias("n_series"))


def weather_cache_join(
    usage: DataFrame, cached: DataFrame, usage_time: str = "date_time", weather_time: str = "wx_time",
) -> DataFrame:
    """As-of join against weather cached per rounded location; near meters share its rows."""
    keyed = usage.select("*", *grid_keys())
    return asof_weather(keyed, cached, ["lat_key", "lon_key"], usage_time, weather_time, times=usage)


def enrich(readings: DataFrame, locations: DataFrame, weather: DataFrame, by: list[str]) -> DataFrame:
    """The enriched panel. The readings alone tell the latest time, without the location join."""
    return asof_weather(join_locations(readings, locations), weather, by, times=readings)
