"""Weather bodies as the archive service returns them: parallel hourly arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowpanel.schemas import WEATHER_JSON


def flatten_weather_json(df: DataFrame, body: str = "body", keep: tuple[str, ...] = (), local_time: bool = False) -> DataFrame:
    """One row per hour. A body without hours gives none; values that are not numbers are NULL."""
    hours = F.arrays_zip(
        F.col("_h.time").alias("time"),
        F.col("_h.temperature_2m").alias("temp"),
        F.col("_h.precipitation").alias("precip"),
        F.col("_h.snowfall").alias("snow"),
    )
    when = F.timestamp_seconds(F.col("_r.time"))
    if local_time:
        # Local wall time stored as if it were UTC: independent of the session zone.
        when = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("_r.time"))
    return (
        df.select(*keep, F.from_json(body, WEATHER_JSON)["hourly"].alias("_h"))
        .select(*keep, F.explode(hours).alias("_r"))
        .select(
            *keep,
            when.alias("date_time"),
            F.col("_r.temp").try_cast("double").alias("temp_c"),
            F.col("_r.precip").try_cast("double").alias("precip_mm"),
            F.col("_r.snow").try_cast("double").alias("snow_cm"),
        )
    )
