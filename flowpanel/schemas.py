"""Table schemas and the fixed column lists of the data model."""

from pyspark.sql import types as T

# Condition columns of a window, in tensor order.
CALENDAR = ["month_sin", "month_cos", "dow_sin", "dow_cos", "hour_sin", "hour_cos"]
USAGE_LAGS = ["usage_15m", "usage_30m", "usage_1h", "usage_6h", "usage_24h", "usage_48h"]
C_IN = CALENDAR + USAGE_LAGS
C_OUT = [
    "temp_c", "precip_mm", "snow_cm", "temp_1h", "temp_24h", "temp_48h",
    "snow_flag", "precip_3d", "snow_24h", "gdd_7d",
]
# The weather columns that are standardised (snow_flag is not).
SCALED_WEATHER = [c for c in C_OUT if c != "snow_flag"]
# Lags and trailing widths, in 15-minute rows.
USAGE_LAG_ROWS = {
    "usage_15m": 1, "usage_30m": 2, "usage_1h": 4, "usage_6h": 24, "usage_24h": 96, "usage_48h": 192,
}
TEMP_LAG_ROWS = {"temp_1h": 4, "temp_24h": 96, "temp_48h": 192}
ROLLING_ROWS = {"precip_3d": 288, "snow_24h": 96, "gdd_7d": 672}
STEPS_PER_DAY = 96
STEP_MINUTES = 15


def _struct(*fields):
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


_S, _D, _I, _L, _TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.TimestampType()
_ARR = T.ArrayType(T.DoubleType())
_MAT = T.ArrayType(T.ArrayType(T.DoubleType()))

LOCATION_CSV = _struct(
    ("Meter_ID", _S), ("Service_Point_Latitude", _D), ("Service_Point_Longitude", _D)
)
LOCATIONS = _struct(("meter_id", _S), ("lat", _D), ("lon", _D))


def weather(time_type=_TS):
    return _struct(("date_time", time_type), ("temp_c", _D), ("precip_mm", _D), ("snow_cm", _D))


def panel(time_type=_TS):
    """The enriched panel. `series_id` is the full source column name, `meter_id` its join key."""
    return _struct(
        ("series_id", _S), ("meter_id", _S), ("date_time", time_type), ("usage", _D),
        ("temp_c", _D), ("precip_mm", _D), ("snow_cm", _D), ("lat", _D), ("lon", _D),
    )


def windows(time_type=_TS):
    return _struct(
        ("series_id", _S), ("window_idx", _L), ("window_start", time_type),
        ("x", _ARR), ("c_in", _MAT), ("c_out", _MAT),
    )


NORM_STATS = T.StructType(
    [T.StructField(f"{c}_{s}", _D, True) for c in ["log"] + SCALED_WEATHER for s in ("mean", "std")]
)
SAMPLES = _struct(("sample_id", _L), ("interval", _I), ("usage", _D))
MATCHED = _struct(("home_id", _S), ("date_time", _TS), ("synthetic_usage", _D))
SCHEDULE = _struct(("t", _I), ("beta", _D), ("alpha", _D), ("alpha_hat", _D))

WEATHER_JSON = T.StructType([
    T.StructField("hourly", T.StructType([
        T.StructField("time", T.ArrayType(T.LongType())),
        T.StructField("temperature_2m", T.ArrayType(T.StringType())),
        T.StructField("precipitation", T.ArrayType(T.StringType())),
        T.StructField("snowfall", T.ArrayType(T.StringType())),
    ])),
])
