"""Wide readings: one timestamp column and one numeric column per meter.

A table of very many meters comes in blocks: a row holds a time, a block and the block's meters in numbered
columns, and a table of names says which series a column of a block is. A plan then has as many columns as a
block, however many meters there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowpanel.functions.ids import id_prefix
from flowpanel.plans.ordered import keep_ids
from flowpanel.plans.ranks import hash_bucket, with_weight_before
from flowpanel.session import materialize

BLOCK, SLOT = "block", "slot"
BLOCK_COLUMNS = 500
BROADCAST_NAMES = 1_000_000  # about 25 MB


def scan_wide_readings(spark: SparkSession, path: str, view: str = "usage_view") -> DataFrame:
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(view)
    return df


def series_columns(wide: DataFrame, time: str = "date_time") -> list[str]:
    return [c for c in wide.columns if c != time]


def _series_name(key: str) -> Column:
    """The name of a series' column; one without an id is named as Spark's pivot does."""
    return F.coalesce(F.col(key).cast("string"), F.lit("null"))


def name_columns(readings: DataFrame, key: str = "series_id", columns: int = BLOCK_COLUMNS) -> DataFrame:
    """Deals the series to blocks of so many columns: `block, slot, series_id`. Slots of a block have no gap."""
    ids = readings.select(key).distinct().select(_series_name(key).alias("series_id")).distinct()
    ids = materialize(ids, "series-ids")  # stored first: a filter on hashes would be moved to the readings
    ids = ids.withColumn("_h", F.md5("series_id"))
    placed = with_weight_before(ids, [], hash_bucket("_h"), ["_h", "series_id"], before="_at", total="_n")
    return placed.select(
        F.floor(F.col("_at") / columns).cast("int").alias(BLOCK), (F.col("_at") % columns).cast("int").alias(SLOT), "series_id")


def slot_columns(first: int, last: int) -> list[str]:
    return [f"s{k}" for k in range(first, last)]


def to_wide(
    readings: DataFrame, names: DataFrame, key: str = "series_id", time: str = "date_time", value: str = "usage",
) -> DataFrame:
    """Long readings as wide rows in blocks: `date_time, block, s0, s1, ...`, the largest reading where several meet.

    Every block has a row for every time of the readings. A series' days move as arrays, and a task has the rows
    of one block and month; a series hashed by its key is not moved to make its days.
    """
    blocks, columns = (0 if n is None else n + 1 for n in names.agg(F.max(BLOCK), F.max(SLOT)).first())
    day, nothing = F.col(time).cast("date").alias("_day"), F.lit(None).cast(readings.schema[value].dataType)
    days = readings.groupBy(key, day).agg(F.collect_list(F.struct(F.col(time), F.col(value))).alias("_v"))
    days = days.withColumn("series_id", _series_name(key)).join(names, "series_id").select(BLOCK, SLOT, "_day", "_v")
    times = readings.select(time).distinct().groupBy(day).agg(F.collect_list(F.struct(F.col(time), nothing.alias(value))).alias("_v"))
    marks = names.select(BLOCK).distinct().crossJoin(times).select(BLOCK, F.lit(-1).alias(SLOT), "_day", "_v")
    dealt = days.unionByName(marks).withColumn("_month", F.trunc("_day", "month"))
    spark = readings.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * blocks)
    dealt = dealt.repartition(tasks, BLOCK, "_month")
    rows = dealt.select(BLOCK, "_month", SLOT, F.explode("_v").alias("_e")).select(BLOCK, "_month", SLOT, "_e.*")
    wide = rows.groupBy(BLOCK, "_month", time).pivot(SLOT, list(range(columns))).agg(F.max(value))
    return wide.select(time, BLOCK, *[F.col(f"`{k}`").alias(c) for k, c in enumerate(slot_columns(0, columns))])


def longer_blocks(wide: DataFrame, names: DataFrame, time: str = "date_time") -> DataFrame:
    """Rows (`series_id, date_time, usage`) of a wide table in blocks, empty readings included.

    A block's names meet its rows as one array before they are exploded. `wide` may have a run of the columns only.
    The names are counted and broadcast; beyond the bound both sides are sorted by block. The rows are never broadcast.
    """
    slots = [c for c in series_columns(wide, time) if c != BLOCK]
    numbers = [int(c[1:]) for c in slots]
    own = names.where(F.col(SLOT).between(min(numbers, default=0), max(numbers, default=-1)))
    listed = F.array_sort(F.collect_list(F.struct(SLOT, "series_id")))
    lists = own.groupBy(BLOCK).agg(F.transform(listed, lambda e: e["series_id"]).alias("_ids"))
    values = F.array(*[F.col(c).cast("double") for c in slots]).cast("array<double>")
    lists = F.broadcast(lists) if own.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES else lists.hint("merge")
    rows = wide.select(time, BLOCK, values.alias("_values")).join(lists, BLOCK)
    rows = rows.select(time, "_ids", F.posexplode("_values").alias("_pos", "usage")).where(F.col("_pos") < F.size("_ids"))
    return rows.select(F.get("_ids", F.col("_pos")).alias("series_id"), time, "usage")


def list_series_ids(wide: DataFrame, time: str = "date_time", names: DataFrame | None = None) -> DataFrame:
    """The series ids of a wide table, from its schema alone; those of a table in blocks from its names."""
    if names is not None:
        return names.select("series_id")
    return wide.sparkSession.createDataFrame([(c,) for c in series_columns(wide, time)], "series_id string")


def unpivot_readings(
    wide: DataFrame, time: str = "date_time", series: list[str] | None = None, names: DataFrame | None = None,
) -> DataFrame:
    """All meters in one scan: `series_id, meter_id, date_time, usage`, NULL usage dropped.

    One pass over the chosen columns; each wide row becomes one array that is exploded, so the
    generated code does not grow with the square of the column count as a projection per column
    would. Positions become names by a lookup as long as the column list; a table in blocks brings its `names`.
    """
    if names is not None:
        rows = longer_blocks(wide, names, time).where(F.col("usage").isNotNull())
        rows = rows if series is None else rows.where(F.col("series_id").isin(series))
        return rows.select("series_id", id_prefix("series_id").alias("meter_id"), time, "usage")
    names = series if series is not None else series_columns(wide, time)
    ids = wide.sparkSession.createDataFrame(list(enumerate(names)), "_pos int, series_id string")
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in names]).cast("array<double>")
    return (
        wide.select(time, F.posexplode(values).alias("_pos", "usage"))
        .where(F.col("usage").isNotNull())
        .join(F.broadcast(ids), "_pos")
        .select("series_id", id_prefix("series_id").alias("meter_id"), time, "usage")
    )


# Columns of a wide table that one scan of `unpivot_in_groups` reads.
GROUP_COLUMNS = 1000


def unpivot_in_groups(
    spark: SparkSession, path: str, target: str, time: str = "date_time", series: list[str] | None = None,
    columns: int = GROUP_COLUMNS, mode: str = "errorifexists", names: DataFrame | None = None,
) -> DataFrame:
    """`unpivot_readings` of a table with very many columns, written to `target` and read back.

    Each scan reads the time and at most `columns` series, so that neither a plan nor a row holds all
    of them; Parquet keeps columns apart, so nothing is read twice but the time. Groups are written
    one after another, each as a folder of its own; a repeated call replaces all of them. The groups of a
    table in blocks, with `names`, are the same columns of every block.
    """
    fields = {f.name: f for f in spark.read.parquet(path).schema.fields}
    keys = [fields[c] for c in (time, BLOCK) if c == time or names is not None]
    if series is not None and names is None:
        wanted = series
    else:
        wanted = [c for c in fields if c not in {k.name for k in keys}]
    empty = unpivot_readings(spark.createDataFrame([], T.StructType([fields[time]])), time, [])
    out = target.rstrip("/")
    for k in range(0, len(wanted), columns):
        own = wanted[k : k + columns]
        wide = spark.read.schema(T.StructType([*keys, *[fields[c] for c in own]])).parquet(path)
        rows = unpivot_readings(wide, time, own) if names is None else unpivot_readings(wide, time, series, names)
        rows.write.mode(mode).parquet(f"{out}/group={k // columns}")
    if not wanted:
        return empty
    back = spark.read.schema(T.StructType([*empty.schema.fields, T.StructField("group", T.IntegerType())])).parquet(out)
    return back.select(*empty.columns)


def limit_series(df: DataFrame, n: int, key: str = "series_id") -> DataFrame:
    """Sanity mode: all rows of the first `n` series by name."""
    ids = df.select(key).distinct().orderBy(key).limit(n)
    return keep_ids(df, ids, [key])
