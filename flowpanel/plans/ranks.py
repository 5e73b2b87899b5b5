"""Order statistics without a single-task sort.

A global or per-group rank is normally one window over the whole group. Here the rows are
spread over buckets that follow the order; bucket totals give each bucket its offset, and only
the rows of one bucket meet in one task. Buckets are functions of the row alone, so a
recomputed task finds the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"
LOG_BUCKETS_PER_E = 4096
MAX_LOG = 711.0  # above log1p of every finite double


def value_bucket(value) -> Column:
    """An order-preserving bucket of a double: log scale, 4096 buckets per factor e.

    Infinities take the bucket beyond the largest finite value.
    """
    v = F.col(value) if isinstance(value, str) else value
    scale = F.least(F.log1p(F.abs(v)), F.lit(MAX_LOG))
    return (F.signum(v) * F.floor(scale * LOG_BUCKETS_PER_E)).cast("int")


def hash_bucket(hashed, bits: int = 14) -> Column:
    """The leading bits (at most 16) of a hash in hexadecimal; sorts as the hash does."""
    return F.shiftright(F.conv(F.substring(hashed, 1, 4), 16, 10).cast("int"), 16 - bits)


def _window(groups: list[str]):
    return Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))


def with_weight_before(
    df: DataFrame, groups: list[str], bucket: Column, order: list, weight: Column | None = None,
    before: str = "before", total: str = "total",
) -> DataFrame:
    """Add the total weight of the rows that precede each row in its group, and the group total.

    `order` must refine `bucket`. Without `weight` these are the 0-based rank and the group size.
    """
    weight = F.lit(1) if weight is None else weight
    rows = df.withColumn(BUCKET, bucket).withColumn("_w", weight.cast("bigint"))
    sums = rows.groupBy(*groups, BUCKET).agg(F.sum("_w").alias("_n"))
    by_bucket = _window(groups).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *groups, BUCKET,
        F.coalesce(F.sum("_n").over(by_bucket), F.lit(0)).alias("_offset"),
        F.sum("_n").over(_window(groups)).alias(total),
    )
    inside = Window.partitionBy(*groups, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(offsets, groups + [BUCKET])
        .withColumn(before, F.col("_offset") + F.coalesce(F.sum("_w").over(inside), F.lit(0)))
        .drop(BUCKET, "_w", "_offset")
    )


def exact_quantile(df: DataFrame, groups: list[str], value: str, p: float, name: str) -> DataFrame:
    """The interpolated (type 7) quantile per group, exact for groups of any size.

    Equal values are combined first, so a group's buffer never holds its values.
    """
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*groups, value).agg(
        F.count(F.lit(1)).alias("_c")
    )
    placed = with_weight_before(counts, groups, value_bucket(value), [value], F.col("_c"))
    at = (F.col("total") - 1) * F.lit(p)
    lower = F.floor(at)

    def value_at(rank: Column) -> Column:
        hit = (F.col("before") <= rank) & (rank < F.col("before") + F.col("_c"))
        return F.max(F.when(hit, F.col(value)))

    upper = F.least(lower + 1, F.col("total") - 1)
    return (
        placed.groupBy(*groups)
        .agg(value_at(lower).alias("_lo"), value_at(upper).alias("_hi"), F.max(at - lower).alias("_f"))
        .select(*groups, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias(name))
    )


def dense_position(df: DataFrame, order: list[str], name: str, single_task_rows: int = 1_000_000) -> DataFrame:
    """Number all rows 1..n by `order` (unique). Counts first; a large table is split by sampled cuts."""
    total = df.count()
    if total <= single_task_rows:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    keep = max(1, total // 2000)
    key = F.struct(*order)
    sample = df.where(F.pmod(F.xxhash64(*order), F.lit(keep)) == 0).select(*order).orderBy(*order)
    # About 2,000 rows whatever the size of the table, sent back as a small table of cuts.
    rows = sample.collect()
    cuts = F.array(*[
        F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, row)])
        for row in rows[:: max(1, len(rows) // 200)]
    ])
    bucket = F.size(F.filter(cuts, lambda cut: cut <= key))
    return with_weight_before(df, [], bucket, order).withColumn(
        name, (F.col("before") + 1).cast("int")
    ).drop("before", "total")
