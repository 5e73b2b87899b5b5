"""Real against synthetic usage: profiles, distributions, labels."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowpanel.functions.calendar import time_of_day
from flowpanel.functions.ids import id_strip_zeros
from flowpanel.operators.access import nonzero_usage
from flowpanel.operators.stats import mean_by
from flowpanel.plans.ranks import dense_position, exact_quantile, value_bucket
from flowpanel.sources.readings import longer_blocks

REAL, SYNTHETIC = "Real", "Synthetic"


def label_source(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("source", F.lit(source))


def relabel_source(source: Column) -> Column:
    """Column names of a profile to labels."""
    return F.when(source == "real_mean", F.lit(REAL)).otherwise(F.lit(SYNTHETIC))


def is_synthetic(source: Column) -> Column:
    return F.when(source == SYNTHETIC, F.lit("Yes")).otherwise(F.lit("No"))


def bind_sources(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Rows of both by column name; a column missing on one side is NULL there."""
    return real.unionByName(synthetic, allowMissingColumns=True)


def bind_seasons(tables: dict[str, DataFrame]) -> DataFrame:
    labelled = [df.withColumn("season", F.lit(season)) for season, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)


def pivot_longer(df: DataFrame, keys: list[str], names: str, values: str) -> DataFrame:
    """Every column but the keys becomes rows of (name, value)."""
    rest = [c for c in df.columns if c not in keys]
    pairs = F.arrays_zip(
        F.array(*[F.lit(c) for c in rest]).alias("n"), F.array(*[F.col(f"`{c}`") for c in rest]).alias("v")
    )
    return df.select(*keys, F.inline(pairs).alias(names, values))


def pivot_longer_traces(wide: DataFrame, time: str = "date_time", names: DataFrame | None = None) -> DataFrame:
    """Wide traces as rows, empty readings included; a table in blocks brings its `names`."""
    if names is not None:
        return longer_blocks(wide, names, time).select(time, F.col("series_id").alias("home_id"), "usage")
    return pivot_longer(wide, [time], "home_id", "usage")


def explode_samples(samples: DataFrame, key: str = "sample_id", value: str = "usage") -> DataFrame:
    return samples.select(key, F.posexplode(value).alias("interval", "usage"))


def mean_profile_by_source(traces: DataFrame, time: str = "time") -> DataFrame:
    return mean_by(traces.withColumn("time_of_day", time_of_day(time)), ["source", "time_of_day"], "usage", "mean_usage")


def profile_compare(windows: DataFrame, value: str = "x") -> DataFrame:
    """Mean per interval of real and synthetic windows side by side."""
    steps = windows.select("source", F.posexplode(value).alias("interval", "usage"))
    return steps.groupBy("interval").agg(
        F.avg(F.when(F.col("source") == REAL, F.col("usage"))).alias("real_mean"),
        F.avg(F.when(F.col("source") == SYNTHETIC, F.col("usage"))).alias("synthetic_mean"),
    )


def wasserstein_1d(df: DataFrame, usage: str = "usage", source: str = "source") -> DataFrame:
    """Exact 1-Wasserstein distance between the positive usage of both sources, as one row.

    The area between the two empirical distribution functions. Equal values are combined before
    they shuffle; running counts are taken within value buckets and shifted by bucket totals, so
    no task sorts a whole sample.
    """
    counts = (
        nonzero_usage(df, usage)
        .groupBy(F.col(usage).alias("v"))
        .agg(
            F.sum(F.when(F.col(source) == REAL, 1).otherwise(0)).alias("r"),
            F.sum(F.when(F.col(source) == SYNTHETIC, 1).otherwise(0)).alias("s"),
        )
        .withColumn("_bucket", value_bucket("v"))
    )
    # At most 711 x 4,096 buckets, the whole range of a double; those of real usage span a few factors of e.
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.groupBy("_bucket").agg(
        F.sum("r").alias("_r"), F.sum("s").alias("_s"), F.min("v").alias("_min")
    ).select(
        "_bucket",
        F.coalesce(F.sum("_r").over(before), F.lit(0)).alias("_r0"),
        F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"),
        F.sum("_r").over(everything).alias("_rn"),
        F.sum("_s").over(everything).alias("_sn"),
        F.lead("_min").over(everything.orderBy("_bucket")).alias("_next"),
    )
    inside = Window.partitionBy("_bucket").orderBy("v")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    steps = counts.join(buckets, "_bucket").select(
        (F.abs(
            (F.col("_r0") + F.sum("r").over(running)) / F.col("_rn")
            - (F.col("_s0") + F.sum("s").over(running)) / F.col("_sn")
        ) * (F.coalesce(F.lead("v").over(inside), F.col("_next")) - F.col("v"))).alias("area")
    )
    return steps.agg(F.sum("area").alias("w1"))


def magnitude_histogram(df: DataFrame, bins_per_decade: int = 10) -> DataFrame:
    """Share of positive usage per logarithmic bin and source."""
    bins = (
        nonzero_usage(df)
        .groupBy("source", F.floor(F.log10("usage") * bins_per_decade).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    share = F.col("n") / F.sum("n").over(Window.partitionBy("source"))
    return bins.withColumn("share", share)


def magnitude_density(df: DataFrame, points: int = 512) -> DataFrame:
    """The density curve of log10 of positive usage per source: `source, point, x, density`.

    A Gaussian kernel estimate on an even grid over the range of all sources. The bandwidth is
    0.9 min(deviation, quartile range / 1.34) n^(-1/5), with exact quartiles. Every value is split
    between its two grid points, so the convolution runs over at most `points` sums per source and its
    cost does not depend on the number of rows. A source of one value, or of equal values, takes the
    deviation's place by |value|, or 1 where that is 0; without positive usage there is no row.
    """
    values = nonzero_usage(df).select("source", F.log10("usage").alias("v")).where(F.col("v") < F.lit(float("inf")))
    whole = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))  # one row
    per = values.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"), F.max(F.abs("v")).alias("size"))
    low, high = (exact_quantile(values, ["source"], "v", q, name) for q, name in ((0.25, "q1"), (0.75, "q3")))
    spread = F.least("sd", (F.col("q3") - F.col("q1")) / 1.34)
    safe = F.when(spread > 1e-9, spread).when(F.col("sd") > 1e-9, F.col("sd")).when(F.col("size") > 0, F.col("size")).otherwise(1.0)
    bands = per.join(low, "source").join(high, "source").select("source", "n", (0.9 * safe * F.pow("n", F.lit(-0.2))).alias("bw"))
    step = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / (points - 1)).otherwise(1.0)
    placed = values.crossJoin(F.broadcast(whole)).select("source", ((F.col("v") - F.col("lo")) / step).alias("at"))
    left = F.least(F.floor("at"), F.lit(points - 2)).cast("int")
    share = F.col("at") - left
    halves = F.array(F.struct(left.alias("bin"), (1 - share).alias("w")), F.struct((left + 1).alias("bin"), share.alias("w")))
    bins = placed.select("source", F.explode(halves).alias("b")).groupBy("source", "b.bin").agg(F.sum("b.w").alias("w"))
    grid = bands.crossJoin(F.broadcast(whole)).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    far = (F.col("point") - F.col("bin")) * step / F.col("bw")
    kernel = F.exp(-far * far / 2) / F.sqrt(F.lit(2 * math.pi)) / F.col("bw")
    # Sums of one source meet the grid points of the same source: `points` squared rows, whatever the data.
    met = grid.join(bins, "source").groupBy("source", "point").agg(
        F.first(F.col("lo") + F.col("point") * step).alias("x"), (F.sum(F.col("w") * kernel) / F.first("n")).alias("density"))
    return met.select("source", "point", "x", "density")


def home_labels(traces: DataFrame, time: str = "time") -> DataFrame:
    """"Home k" per cleaned id, numbered by first appearance: real rows first, then time, then id."""
    cleaned = traces.select(
        id_strip_zeros("home_id").alias("home_id"),
        F.when(F.col("source") == REAL, 0).otherwise(1).alias("_s"), F.col(time).alias("_t"),
    )
    first = cleaned.groupBy("home_id").agg(F.min(F.struct("_s", "_t")).alias("_f"))
    ordered = first.select("home_id", F.col("_f._s").alias("_s"), F.col("_f._t").alias("_t"))
    placed = dense_position(ordered, ["_s", "_t", "home_id"], "home_no")
    return placed.select("home_id", "home_no", F.concat(F.lit("Home "), F.col("home_no")).alias("label"))
