"""Calendar, lag and rolling-sum features.

Lags and widths count rows, not time: after a data gap `usage_24h` is older than 24 hours. Lags can
be asked for by time instead, which leaves them NULL there.
Hourly rain and snow are carried onto every 15-minute row, so their trailing sums are four
times the physical total; the statistics of the model expect that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from flowpanel.functions.calendar import cyclic_calendar
from flowpanel.operators.access import drop_incomplete
from flowpanel.plans.ordered import CHECK, over_series
from flowpanel.schemas import CALENDAR, ROLLING_ROWS, STEP_MINUTES, TEMP_LAG_ROWS, USAGE_LAG_ROWS

GDD_BASE_C = 10.0


def add_calendar(df: DataFrame, time: str = "date_time") -> DataFrame:
    return df.withColumns(cyclic_calendar(time))


def snow_flag(snow="snow_cm") -> Column:
    s = F.col(snow) if isinstance(snow, str) else snow
    return F.when(s > 0, F.lit(1.0)).when(s <= 0, F.lit(0.0))


def gdd_base(temp="temp_c", base: float = GDD_BASE_C) -> Column:
    """max(temp - base, 0); NULL stays NULL, which `greatest` alone would turn into 0."""
    t = F.col(temp) if isinstance(temp, str) else temp
    return F.when(t.isNotNull(), F.greatest(t - F.lit(base), F.lit(0.0)))


def lag_columns(w: WindowSpec, source: str, lags: dict[str, int]) -> dict[str, Column]:
    return {name: F.lag(source, k).over(w) for name, k in lags.items()}


def _usable(value: Column) -> Column:
    """NaN and infinities would poison a running sum; they count as missing."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def _add_rolling(
    df: DataFrame, w: WindowSpec, sources: dict[str, tuple[Column, int]], also: dict[str, Column] | None = None
) -> DataFrame:
    """Trailing sums as differences of running sums: the cost does not grow with the width.

    Partial frames at the start of a series are summed as they are; a frame with a missing
    value gives NULL. `also` are other columns over `w`, computed in the same pass.
    """
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    first = {}
    for name, (value, _) in sources.items():
        usable = _usable(value)
        first[f"_s_{name}"] = F.sum(F.coalesce(usable, F.lit(0.0))).over(running)
        first[f"_m_{name}"] = F.sum(F.when(usable.isNull(), 1).otherwise(0)).over(running)
    sums = df.withColumns({**first, **(also or {})})
    out = {}
    for name, (_, width) in sources.items():
        total, missing = F.col(f"_s_{name}"), F.col(f"_m_{name}")
        missing_before = F.coalesce(F.lag(missing, width).over(w), F.lit(0))
        total_before = F.coalesce(F.lag(total, width).over(w), F.lit(0.0))
        out[name] = F.when(missing == missing_before, total - total_before)
    return sums.withColumns(out).drop(*first)


def rolling_sources(widths: dict[str, int] | None = None) -> dict[str, tuple[Column, int]]:
    w = {**ROLLING_ROWS, **(widths or {})}
    return {
        "precip_3d": (F.col("precip_mm"), w["precip_3d"]),
        "snow_24h": (F.col("snow_cm"), w["snow_24h"]),
        "gdd_7d": (gdd_base(), w["gdd_7d"]),
    }


def add_lags(df: DataFrame, source: str, lags: dict[str, int], hot: DataFrame | str | None = CHECK, **split) -> DataFrame:
    return over_series(
        df, lambda rows, w: rows.withColumns(lag_columns(w, source, lags)), max(lags.values()), hot=hot, **split
    )


def lag_temp(df: DataFrame, hot: DataFrame | str | None = CHECK, time_based: bool = False, **split) -> DataFrame:
    """Temperature lags by row, or by instant with `time_based`, which needs no count of long series."""
    return add_time_lags(df, "temp_c", TEMP_LAG_ROWS) if time_based else add_lags(df, "temp_c", TEMP_LAG_ROWS, hot, **split)


def lag_usage(df: DataFrame, hot: DataFrame | str | None = CHECK, time_based: bool = False, **split) -> DataFrame:
    """Usage lags by row, or by instant with `time_based`."""
    return add_time_lags(df, "usage", USAGE_LAG_ROWS) if time_based else add_lags(df, "usage", USAGE_LAG_ROWS, hot, **split)


def add_time_lags(
    df: DataFrame, source: str, lags: dict[str, int], step_minutes: int = STEP_MINUTES,
    key: str = "series_id", time: str = "date_time",
) -> DataFrame:
    """Lags by instant instead of by row: the value exactly so many steps earlier, NULL across a gap.

    Every value is written once per lag to the instant that looks back at it; those of one instant
    meet in one group, which rows find by an equi join on series and time. Nothing needs the order
    of a series, so a long one is spread over its instants. Where an instant repeats, the largest of
    its values counts; a NULL or NaN value counts as none.
    """
    shift = F.explode(F.array(*[F.struct(F.lit(name).alias("_lag"), F.lit(k * step_minutes).alias("_m")) for name, k in lags.items()]))
    value = F.col(source)
    seen = df.where(value.isNotNull() & ~F.isnan(value)).select(key, F.col(time).alias("_t"), value.alias("_v"), shift.alias("_l"))
    later = F.col("_t") + F.make_dt_interval(mins=F.col("_l._m"))
    by_instant = seen.select(key, later.alias(time), "_l._lag", "_v").groupBy(key, time).agg(
        *[F.max(F.when(F.col("_lag") == name, F.col("_v"))).alias(name) for name in lags])
    return df.join(by_instant, [key, time], "left").select(*[f"`{c}`" for c in df.columns], *lags)


def rolling_sums(
    df: DataFrame, widths: dict[str, int] | None = None, hot: DataFrame | str | None = CHECK, **split
) -> DataFrame:
    sources = rolling_sources(widths)
    lookback = max(width for _, width in sources.values())
    return over_series(df, lambda rows, w: _add_rolling(rows, w, sources), lookback, hot=hot, **split)


def build_features(
    panel: DataFrame, time: str = "date_time", hot: DataFrame | str | None = CHECK, complete_only: bool = True, **split
) -> DataFrame:
    """All 19 features with one shuffle and one sort by (series, time).

    The calendar needs no order and is computed after the shuffle, so it is not moved. It is missing only where the
    time is, so rows are dropped before it: those that go need none, and who does not ask for it pays nothing.
    """
    sources = rolling_sources()

    def add(rows: DataFrame, w: WindowSpec) -> DataFrame:
        lags = {**lag_columns(w, "temp_c", TEMP_LAG_ROWS), **lag_columns(w, "usage", USAGE_LAG_ROWS)}
        return _add_rolling(rows, w, sources, lags)

    lookback = max(max(USAGE_LAG_ROWS.values()), max(width for _, width in sources.values()))
    wide = over_series(panel, add, lookback, time=time, hot=hot, **split)
    done = wide.withColumn("snow_flag", snow_flag())
    done = add_calendar(drop_incomplete(done) if complete_only else done, time)
    return done.select(*panel.columns, *CALENDAR, *TEMP_LAG_ROWS, "snow_flag", *ROLLING_ROWS, *USAGE_LAG_ROWS)
