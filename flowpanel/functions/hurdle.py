"""Zero-inflated encoding: an occurrence mask and a standardised log magnitude.

Encoding divides by std + 1e-6 while decoding multiplies by std, so a round trip is exact
only to about 1e-6 relative.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowpanel.schemas import C_OUT

# Fixed values.
EPS = 1e-6
LOG_CLIP = 10.0
GATE_GENERATED = 0.1
GATE_REAL = 0.5


def occurrence(usage: Column) -> Column:
    return F.when(usage > 0, F.lit(1.0)).otherwise(F.lit(0.0))


def log_z(usage: Column, mean: float, std: float) -> Column:
    return (F.log1p(F.greatest(usage, F.lit(0.0))) - F.lit(mean)) / F.lit(std + EPS)


def magnitude(usage: Column, mean: float, std: float, masked: bool = True) -> Column:
    """Standardised log usage; 0 where nothing flows, unless `masked` is off."""
    z = log_z(usage, mean, std)
    return F.when(usage > 0, z).otherwise(F.lit(0.0)) if masked else z


def scale_weather(value: Column, name: str, stats: dict[str, float], flag_scaled: bool = False) -> Column:
    """Standardise one outdoor condition. `snow_flag` stays raw unless `flag_scaled`."""
    if name == "snow_flag" and not flag_scaled:
        return value
    mean, std = stats.get(f"{name}_mean", 0.0), stats.get(f"{name}_std", 1.0)
    return (value - F.lit(mean)) / F.lit(std + EPS)


def decode(mask: Column, z: Column, mean: float, std: float, threshold: float = GATE_GENERATED) -> Column:
    level = F.greatest(F.least(z * F.lit(std) + F.lit(mean), F.lit(LOG_CLIP)), F.lit(-LOG_CLIP))
    return F.when(mask > threshold, F.greatest(F.expm1(level), F.lit(0.0))).otherwise(F.lit(0.0))


# Array forms, for windows that are already cut.


def encode_window(x: Column, stats: dict[str, float]) -> Column:
    """`x[n]` to `[mask[n], z[n]]`."""
    mean, std = stats["log_mean"], stats["log_std"]
    return F.array(F.transform(x, occurrence), F.transform(x, lambda v: magnitude(v, mean, std)))


def decode_window(encoded: Column, stats: dict[str, float], threshold: float = GATE_GENERATED) -> Column:
    mean, std = stats["log_mean"], stats["log_std"]
    return F.zip_with(
        F.element_at(encoded, 1), F.element_at(encoded, 2),
        lambda m, v: decode(m, v, mean, std, threshold),
    )


def scale_indoor(c_in: Column, stats: dict[str, float], masked: bool = True, n_calendar: int = 6) -> Column:
    """Standardise the usage lags (the rows after the calendar rows) of an indoor matrix."""
    mean, std = stats["log_mean"], stats["log_std"]
    return F.transform(
        c_in,
        lambda row, i: F.when(i < n_calendar, row).otherwise(
            F.transform(row, lambda v: magnitude(v, mean, std, masked))
        ),
    )


def scale_outdoor(c_out: Column, stats: dict[str, float], flag_scaled: bool = False) -> Column:

    def scale_row(i: int, name: str) -> Column:
        return F.transform(F.element_at(c_out, i + 1), lambda v: scale_weather(v, name, stats, flag_scaled))

    return F.array(*[scale_row(i, name) for i, name in enumerate(C_OUT)])


def is_finite(values: Column) -> Column:
    return F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
