"""CSV and JSON sources and sinks around the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowpanel.schemas import NORM_STATS


def scan_by_extension(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read all files of a directory in the format of its first data file (CSV or Parquet)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []
    kinds = [n.rsplit(".", 1)[-1] for n in names if n.endswith((".csv", ".parquet"))]
    if not kinds:
        raise FileNotFoundError(f"no CSV or Parquet files in {path}")
    reader = spark.read.option("pathGlobFilter", f"*.{kinds[0]}")
    if schema is not None:
        reader = reader.schema(schema)
    elif kinds[0] == "csv":
        reader = reader.option("inferSchema", True)
    return reader.option("header", True).csv(path) if kinds[0] == "csv" else reader.parquet(path)


def read_trace_csv(
    spark: SparkSession, path: str, column: str | None = None, time: str = "date_time", local_time: bool = True,
) -> DataFrame:
    """A wide trace CSV with typed columns; `column` picks one home as `usage`."""
    raw = spark.read.option("header", True).csv(path)
    parse = F.to_timestamp_ntz if local_time else F.to_timestamp
    homes = [column] if column else [c for c in raw.columns if c != time]
    out = [F.col(f"`{c}`").cast("double").alias("usage" if column else c) for c in homes]
    return raw.select(parse(F.col(time)).alias(time), *out)


def write_samples_csv(df: DataFrame, path: str, mode: str = "errorifexists", folders: tuple[str, ...] = ()) -> None:
    """With `folders` the rows lie in one folder per value of these columns."""
    df.write.mode(mode).option("header", True).partitionBy(*folders).csv(path)


def write_norm_stats(stats: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object: the table holds a single row."""
    stats.coalesce(1).write.mode(mode).json(path)


def read_norm_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NORM_STATS).json(path)


def norm_stats_dict(stats: DataFrame) -> dict[str, float]:
    """The single row of statistics as plain numbers, to be used as literals in expressions."""
    return {k: float(v) for k, v in stats.first().asDict().items()}
