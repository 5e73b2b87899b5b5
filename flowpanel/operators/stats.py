"""Summaries and normalisation statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowpanel.plans.ranks import exact_quantile
from flowpanel.schemas import SCALED_WEATHER


def panel_summary(panel: DataFrame, time: str = "date_time") -> DataFrame:
    """Data health per meter: rows, missing weather in percent, usage range, first and last day."""
    n = F.count(F.lit(1))

    def missing(c: str) -> Column:
        return F.round(F.lit(100.0) * F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)) / n, 2)

    return (
        panel.groupBy("meter_id")
        .agg(
            n.alias("n_obs"),
            missing("temp_c").alias("pct_missing_temp"),
            missing("precip_mm").alias("pct_missing_precip"),
            missing("snow_cm").alias("pct_missing_snow"),
            F.min("usage").alias("min_usage"),
            F.max("usage").alias("max_usage"),
            F.to_date(F.min(time)).alias("date_start"),
            F.to_date(F.max(time)).alias("date_end"),
        )
        .orderBy("meter_id")
    )


def norm_stats(features: DataFrame, population: str = "all") -> DataFrame:
    """Mean and sample deviation of log(usage + 1) and of nine weather columns, in one row.

    `population` is "all" (usage >= 0) or "nonzero". Statistics without data default to 0 and 1.
    """
    usage = F.col("usage")
    keep = usage > 0 if population == "nonzero" else usage >= 0
    columns = {"log": F.log1p(usage), **{c: F.col(c) for c in SCALED_WEATHER}}
    out = []
    for name, value in columns.items():
        out.append(F.coalesce(F.avg(value), F.lit(0.0)).alias(f"{name}_mean"))
        out.append(F.coalesce(F.stddev_samp(value), F.lit(1.0)).alias(f"{name}_std"))
    return features.where(~F.isnan(usage) & keep).agg(*out)


def count_by_meter(panel: DataFrame) -> DataFrame:
    return panel.groupBy("meter_id").agg(F.count(F.lit(1)).alias("n"))


def mean_by(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Mean of the values that are present; NaN counts as missing."""
    return df.groupBy(*keys).agg(F.avg(F.when(~F.isnan(value), F.col(value))).alias(name))


def mean_profile(samples: DataFrame) -> DataFrame:
    return mean_by(samples, ["interval"], "usage", "usage")


def temp_profile(panel: DataFrame, time) -> DataFrame:
    return mean_by(panel.withColumn("time", time), ["time"], "temp_c", "temp_c")


def peak_usage(df: DataFrame, key: str, usage: str = "usage") -> DataFrame:
    return df.groupBy(key).agg(F.max(usage).alias("peak"))


def adversarial_features(traces: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Five summary features per (source, home): mean, peak, zero share, variance, 90th percentile.

    The percentile is exact and interpolated but never holds a home's values in one buffer.
    """
    keys = keys or ["source", "home_id"]
    usage = F.col("usage")
    base = traces.where(usage.isNotNull() & ~F.isnan(usage))
    moments = base.groupBy(*keys).agg(
        F.avg(usage).alias("mean_usage"),
        F.max(usage).alias("max_peak"),
        F.avg(F.when(usage == 0, 1.0).otherwise(0.0)).alias("zero_proportion"),
        F.coalesce(F.var_samp(usage), F.lit(0.0)).alias("usage_variance"),
    )
    return moments.join(exact_quantile(base, keys, "usage", 0.9, "p90_usage"), keys)


def moments_by_source(traces: DataFrame) -> DataFrame:
    return traces.groupBy("source").agg(
        F.avg("usage").alias("mean_usage"), F.var_samp("usage").alias("var_usage")
    )


def conditional_mean(panel: DataFrame, bin_c: float = 5.0) -> DataFrame:
    """Mean usage per temperature bin and wet or dry, where both are known."""
    return (
        panel.where(F.col("temp_c").isNotNull() & F.col("precip_mm").isNotNull())
        .groupBy(F.floor(F.col("temp_c") / bin_c).alias("temp_bin"), (F.col("precip_mm") > 0).alias("wet"))
        .agg(F.avg("usage").alias("mean_usage"), F.count(F.lit(1)).alias("n"))
    )
