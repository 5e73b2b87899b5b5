"""Date and time expressions for zoned (TIMESTAMP) and local (TIMESTAMP_NTZ) columns."""

import datetime as dt
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_local_time(df: DataFrame, time: str) -> bool:
    return isinstance(df.schema[time].dataType, T.TimestampNTZType)


def instant_literal(df: DataFrame, time: str, value) -> Column:
    """`value` as a literal of the type of column `time`.

    Text and Python times without a zone are read in the session zone, not in that of the driver.
    """
    if isinstance(value, dt.datetime):
        value = value.isoformat(sep=" ")
    return F.lit(value).cast(df.schema[time].dataType)


def elapsed_seconds(df: DataFrame, time: str, start: Column, end: Column) -> Column:
    """Elapsed seconds between two values of the type of column `time`.

    Zoned values are compared as instants, so a repeated or skipped local hour counts as it
    passed; local values are compared as written and never see the session zone.
    """
    if is_local_time(df, time):
        gap = end - start
        return (
            F.extract(F.lit("DAY"), gap) * 86400
            + F.extract(F.lit("HOUR"), gap) * 3600
            + F.extract(F.lit("MINUTE"), gap) * 60
            + F.extract(F.lit("SECOND"), gap).cast("double")
        ).cast("double")
    return ((F.unix_micros(end) - F.unix_micros(start)) / 1_000_000).cast("double")


def cycle(value: Column, period: int) -> Column:
    return F.lit(2 * math.pi) * value / F.lit(period)


def cyclic_calendar(time) -> dict[str, Column]:
    """Sine and cosine of month, weekday (Sunday is 1) and fractional hour."""
    t = F.col(time) if isinstance(time, str) else time
    parts = {
        "month": cycle(F.month(t), 12),
        "dow": cycle(F.dayofweek(t), 7),
        "hour": cycle(F.hour(t) + F.minute(t) / 60, 24),
    }
    return {
        f"{name}_{fn.__name__}": fn(angle) for name, angle in parts.items() for fn in (F.sin, F.cos)
    }


def time_of_day(time) -> Column:
    return F.date_format(time, "HH:mm:ss")


def align_to_day(time) -> Column:
    """The clock time of `time` on 2000-01-01, so that days can share one axis."""
    return F.make_timestamp_ntz(
        F.lit(2000), F.lit(1), F.lit(1), F.hour(time), F.minute(time), F.second(time)
    )


def month_label(time) -> Column:
    return F.date_format(time, "MMM")


def year_range(df: DataFrame, time: str, first: int, last: int) -> Column:
    """`year(time)` between two years as a half-open range, which a Parquet scan can push down."""
    t = F.col(time)
    return (t >= instant_literal(df, time, f"{first}-01-01 00:00:00")) & (
        t < instant_literal(df, time, f"{last + 1}-01-01 00:00:00")
    )
