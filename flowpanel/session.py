"""Session helpers: a tuned builder and the shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


def build_session(app: str = "flowpanel", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and the display zone of the meters."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "America/Denver",
        # One native thread per Python worker: Spark already runs one worker per core.
        "spark.executorEnv.OMP_NUM_THREADS": "1",
        "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors can read, as the cluster names it.

    A machine-local folder is used only by a local session that names none.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="flowpanel-")
    return _LOCAL_DIRS[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write `df` as Parquet into the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._cut_path = path
    return back


def materialize_by_key(df: DataFrame, name: str, key: str, time: str, buckets: int) -> str:
    """Write `df` into the shared folder as a table hashed by `key` and sorted by time; returns the table's name.

    Plans per key read it without a shuffle, and whatever is joined to it by broadcast keeps that. Rows that arrive
    hashed into as many partitions give one file per bucket.
    """
    table = f"{name}_{uuid.uuid4().hex}"
    path = new_path(df.sparkSession, name)
    df.write.bucketBy(buckets, key).sortBy(key, time).option("path", path).format("parquet").saveAsTable(table)
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by `materialize` whose successors are written."""
    for df in tables:
        path = getattr(df, "_cut_path", None)
        if path:
            delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any store that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """Distribute rows evenly before work that costs much per row.

    Small tables arrive in few partitions, which would leave most cores idle; the number is the
    larger of the cores and the shuffle partitions of the session. Rows are dealt by a hash of the keys:
    by the keys themselves the exchange is dropped after a grouping by the same ones, and adaptive
    execution then joins the grouping's small partitions to one.
    """
    spark = df.sparkSession
    n = partitions or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, F.xxhash64(*keys)) if keys else df.repartition(n)
