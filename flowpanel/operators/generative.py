"""Data jobs around a diffusion model: schedule, noised pairs, scenarios, batch sampling."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowpanel.functions import hurdle, kernels
from flowpanel.functions.calendar import cycle as angle_of
from flowpanel.functions.hashing import hash_key, normal, pick, uniform
from flowpanel.schemas import C_OUT, STEPS_PER_DAY
from flowpanel.session import spread

# Fixed values of the noise schedule and of sampling.
T = 1000
BETA_FIRST, BETA_LAST = 1e-4, 0.02
TEMPERATURE = 0.8
BASE_LAG_USAGE = 0.1
BASELINE_ZERO_SHARE = 0.6


def noise_schedule(spark: SparkSession, steps: int = T, first: float = BETA_FIRST, last: float = BETA_LAST) -> DataFrame:
    """`t, beta, alpha, alpha_hat` of a linear schedule; `alpha_hat` is the running product."""
    beta = F.lit(first) + F.col("t") * F.lit((last - first) / (steps - 1))
    rows = spark.range(steps).select(F.col("id").cast("int").alias("t")).withColumn("beta", beta)
    rows = rows.withColumn("alpha", 1 - F.col("beta"))
    w = Window.partitionBy(F.lit(0)).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("alpha_hat", F.exp(F.sum(F.log("alpha")).over(w)))


def with_schedule(df: DataFrame, schedule: DataFrame, t: str = "t") -> DataFrame:
    """Look up the schedule of each row's step. The schedule has one row per step (1,000)."""
    return df.join(F.broadcast(schedule), t)


def forward_noise(tensors: DataFrame, schedule: DataFrame, seed: int = 42, steps: int = T) -> DataFrame:
    """Noised training pairs: `t` uniform in [0, T), `x_t = sqrt(a) x0 + sqrt(1 - a) eps`."""
    timed = tensors.withColumn("t", pick(seed, steps, "series_id", "window_idx").cast("int"))
    keyed = timed.withColumn("_key", hash_key(seed, "series_id", "window_idx"))

    def noise_row(row: Column, channel: Column) -> Column:
        return F.transform(row, lambda _, i: normal(seed, "_key", channel, i))

    noised = with_schedule(keyed, schedule).withColumn("eps", F.transform("x", noise_row))
    signal, spread = F.sqrt("alpha_hat"), F.sqrt(1 - F.col("alpha_hat"))

    def mix(x_row: Column, e_row: Column) -> Column:
        return F.zip_with(x_row, e_row, lambda x, e: signal * x + spread * e)

    return noised.withColumn("x_t", F.zip_with("x", "eps", mix)).drop("beta", "alpha", "_key")


def noise_mse(df: DataFrame, eps: str = "eps", predicted: str = "predicted") -> DataFrame:
    """Mean squared error over all elements of two flat arrays per row."""
    squares = F.aggregate(
        F.zip_with(eps, predicted, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v
    )
    return df.agg((F.sum(squares) / F.sum(F.size(eps))).alias("mse"))


def fit_gaussian(tensors: DataFrame, strata: list[str]) -> DataFrame:
    """Per stratum, channel and step the mean and population variance of the encoded windows."""
    rows = tensors.select(*strata, F.posexplode("x").alias("channel", "_row"))
    cells = rows.select(*strata, "channel", F.posexplode("_row").alias("interval", "_v"))
    return cells.groupBy(*strata, "channel", "interval").agg(
        F.avg("_v").alias("mu"), F.var_pop("_v").alias("var"), F.count(F.lit(1)).alias("n")
    )


def gaussian_arrays(fitted: DataFrame, strata: list[str]) -> DataFrame:
    """The fitted table as one row per stratum: `mu[2][n]`, `var[2][n]`."""
    def ordered(cells: str, field: str) -> Column:
        return F.sort_array(cells).getField(field)

    channels = fitted.groupBy(*strata, "channel").agg(F.collect_list(F.struct("interval", "mu", "var")).alias("_c"))
    rows = channels.select(*strata, "channel", ordered("_c", "mu").alias("mu"), ordered("_c", "var").alias("var"))
    both = rows.groupBy(*strata).agg(F.collect_list(F.struct("channel", "mu", "var")).alias("_c"))
    return both.select(*strata, ordered("_c", "mu").alias("mu"), ordered("_c", "var").alias("var"))


def gaussian_noise(x_t: Column, alpha_hat: Column, mu: Column, var: Column) -> Column:
    """The closed-form noise estimate for flat arrays."""
    pair = F.arrays_zip(mu.alias("mu"), var.alias("var"))
    return F.zip_with(
        x_t, pair,
        lambda x, p: F.sqrt(1 - alpha_hat) * (x - F.sqrt(alpha_hat) * p["mu"]) / (alpha_hat * p["var"] + 1 - alpha_hat),
    )


def cross_scenarios(samples: DataFrame, profile: DataFrame, interval: str = "interval", steps: int = STEPS_PER_DAY) -> DataFrame:
    """Every sample at every interval, with the condition profile of that interval (one row each)."""
    grid = samples.withColumn(interval, F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    return grid.join(profile, interval)


def scenario_encode(
    scenarios: DataFrame, stats: dict[str, float], lag_usage: float = BASE_LAG_USAGE, steps: int = STEPS_PER_DAY
) -> DataFrame:
    """Condition tensors from one row per scenario.

    Input: `month`, `dow` (Sunday is 1) and the raw outdoor conditions that are known; missing
    ones count as 0, missing temperature lags as the temperature and the snow flag follows the
    snow. The hour varies over the steps, everything else is constant.
    """
    def const(value: Column) -> Column:
        return F.array_repeat(value.cast("double"), steps)

    def cycle(value: Column, period: int) -> list[Column]:
        return [const(F.sin(angle_of(value, period))), const(F.cos(angle_of(value, period)))]

    hours = F.sequence(F.lit(0), F.lit(steps - 1))
    angle = 2 * math.pi / steps
    clock = [F.transform(hours, lambda i: F.sin(i * angle)), F.transform(hours, lambda i: F.cos(i * angle))]
    lag = const(hurdle.log_z(F.lit(lag_usage), stats["log_mean"], stats["log_std"]))

    def raw(name: str) -> Column:
        if name in scenarios.columns:
            return F.col(name)
        if name.startswith("temp_"):
            return F.col("temp_c")
        if name == "snow_flag" and "snow_cm" in scenarios.columns:
            return F.when(F.col("snow_cm") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
        return F.lit(0.0)

    outdoor = [const(hurdle.scale_weather(raw(c), c, stats)) for c in C_OUT]
    return scenarios.withColumns({
        "c_in": F.array(*cycle(F.col("month"), 12), *cycle(F.col("dow"), 7), *clock, *[lag] * 6),
        "c_out": F.array(*outdoor),
    })


def reverse_sample(
    scenarios: DataFrame, sample_id: str = "sample_id", steps: int = T, first: float = BETA_FIRST,
    last: float = BETA_LAST, temperature: float = TEMPERATURE, seed: int = 42,
    predictor: Callable | None = None, conditions: tuple[str, ...] = (), partitions: int | None = None,
) -> DataFrame:
    """Denoise one trace per scenario row, all rows of a batch together.

    Rows carry `mu[2][n]` and `var[2][n]` for the default predictor and any array `conditions`
    for another one: `predictor(x, t, alpha_hat, batch) -> noise`. The work is per row, so rows
    are spread evenly first. Noise is keyed by `sample_id` (an integer) and the seed.
    """
    noise = predictor or kernels.gaussian_noise_estimate
    denoise = kernels.reverse_diffusion
    names = ["mu", "var", *conditions]

    def run(batches):
        import numpy as np
        import pandas as pd

        betas = np.linspace(first, last, steps)
        for rows in batches:
            if len(rows) == 0:
                continue
            batch = {c: np.stack([np.stack(list(m)) for m in rows[c]]) for c in names}
            keys = [int(k) for k in rows[sample_id]]
            x = denoise(batch, keys, betas, seed, temperature, noise)
            yield pd.DataFrame({
                sample_id: rows[sample_id].to_numpy(),
                "x": [[list(map(float, channel)) for channel in trace] for trace in x],
            })

    return spread(scenarios.select(sample_id, *names), sample_id, partitions=partitions).mapInPandas(run, f"{sample_id} bigint, x array<array<double>>")


def decode_samples(samples: DataFrame, stats: dict[str, float], threshold: float = hurdle.GATE_GENERATED) -> DataFrame:
    return samples.withColumn("x", hurdle.decode_window(F.col("x"), stats, threshold))


def synthetic_baseline(homes: DataFrame, profile: DataFrame, home: str = "home_id", seed: int = 42) -> DataFrame:
    """Parametric traces: lognormal usage that rises with temperature above 20 C, 60 % zeros.

    `profile` has `interval` and `temp_c`. Noise is keyed by home and interval.
    """
    rows = cross_scenarios(homes.select(home), profile)
    level = F.lit(-1.0) + F.greatest(F.lit(0.0), (F.coalesce(F.col("temp_c"), F.lit(20.0)) - 20) * 0.05)
    flow = F.exp(level + normal(seed, home, "interval"))
    dry = uniform(seed, F.lit("dry"), home, "interval") < BASELINE_ZERO_SHARE
    return rows.select(home, "interval", F.when(dry, F.lit(0.0)).otherwise(flow).alias("usage"), F.lit("Synthetic").alias("source"))


def sample_key(seed: int, *keys) -> Column:
    """A 64-bit sample id for `reverse_sample` from any key columns."""
    return hash_key(seed, *keys)
