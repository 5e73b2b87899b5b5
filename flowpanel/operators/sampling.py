"""Deterministic sampling and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowpanel.functions.hashing import text_key
from flowpanel.functions.ids import id_strip_zeros

FALLBACK_PEAK = 10.0  # Fixed value: the peak of a home without a real trace.


def sample_homes(
    df: DataFrame, n: int, seed: int = 42, groups: tuple[str, ...] = ("source",), home: str = "home_id"
) -> DataFrame:
    """`n` homes per group without replacement; all of them where fewer exist.

    Homes are taken in the order of a seeded hash. Each task keeps its own first `n` per group
    before anything is shuffled.
    """
    homes = df.select(*groups, home).distinct().withColumn("_h", text_key(seed, *groups, home))
    order = Window.partitionBy(*groups).orderBy("_h", home)
    return homes.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_h", "_k")


def match_real_peak(
    homes: DataFrame, peaks: DataFrame, home: str = "home_id", real: str = "real_id",
    fallback: float = FALLBACK_PEAK,
) -> DataFrame:
    """The peak of the real trace with the same id, leading zeros aside; a fallback without one."""
    left = homes.withColumn("_id", id_strip_zeros(home))
    right = peaks.groupBy(id_strip_zeros(real).alias("_id")).agg(F.max("peak").alias("_peak"))
    return left.join(right, "_id", "left").withColumn(
        "real_peak", F.coalesce("_peak", F.lit(fallback))
    ).drop("_id", "_peak")


def match_by_part(
    homes: DataFrame, columns: DataFrame, home: str = "home_id", name: str = "name", position: str = "position",
    value: str = "peak", strip_zeros: bool = True, fallback: float | None = FALLBACK_PEAK,
) -> DataFrame:
    """The peak of the first column, by `position`, whose name contains the home's id; else the fallback.

    `contains` is turned into an equi join: an index holds every part of every column name, and the
    first column of each part, so the pairs of homes and columns are never formed. Names are short, a
    name of n characters has n (n + 1) / 2 parts. With `strip_zeros`, ids and names lose their leading
    zeros first. An empty id is part of every name; a NULL id matches nothing.
    """
    clean = id_strip_zeros if strip_zeros else (lambda c: F.col(c).cast("string"))
    named = columns.where(F.col(name).isNotNull()).select(clean(name).alias("_name"), F.col(position).alias("_p"), F.col(value).alias("_v"))
    size = F.length("_name")
    starts = F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: F.transform(
        F.sequence(F.lit(0), size - i), lambda n: F.substring(F.col("_name"), i + 1, n)))
    parts = named.select(F.explode(F.array_distinct(F.flatten(starts))).alias("_part"), "_p", "_v")
    first = parts.groupBy("_part").agg(F.min_by("_v", "_p").alias("real_peak"))
    found = homes.withColumn("_part", clean(home)).join(first, "_part", "left").drop("_part")
    return found if fallback is None else found.withColumn("real_peak", F.coalesce("real_peak", F.lit(fallback)))


def best_of_n(
    candidates: DataFrame, targets: DataFrame, home: str = "home_id", candidate: str = "candidate_id",
    trace: str = "x",
) -> DataFrame:
    """Per home the candidate trace whose peak is closest to the real one; the first wins ties."""
    scored = candidates.join(targets.select(home, "real_peak"), home).withColumn(
        "diff", F.abs(F.array_max(trace) - F.col("real_peak"))
    )
    best = scored.groupBy(home).agg(
        F.min_by(F.struct(candidate, "diff", trace), F.struct("diff", candidate)).alias("_b")
    )
    return best.select(home, f"_b.{candidate}", "_b.diff", f"_b.{trace}")
