"""Shared helpers of the training-data operators: inputs, lineage cuts, text chunks, components."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowpanel.session import new_path

# Texts are handed to numpy in pieces of about this many bytes; a longer text is one piece.
CHUNK_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: `df` as zstd Parquet in the shared folder, read back."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._cut_path = path
    return back


def release(*tables: DataFrame | None) -> None:
    """Delete tables made by `cut` whose successors are written."""
    for df in tables:
        path = getattr(df, "_cut_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            conf = df.sparkSession._jsc.hadoopConfiguration()
            where.getFileSystem(conf).delete(where, True)


def once(value: Column) -> Column:
    """`value`, evaluated where it stands.

    Spark moves filters (also those it infers from joins and explodes) below the columns they use
    and repeats their definition there; inside a lambda that would cut a text into words for every
    element. A column that counts as non-deterministic is left in its place.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def local_path(uri: str) -> str | None:
    """The local path of a file: address or a plain path, None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if os.path.isabs(uri) else None


def text_chunks(batches: Iterator[pa.RecordBatch], ids: str, text: str) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, UTF-8 texts) of at most about CHUNK_BYTES; a null text is empty."""
    for batch in batches:
        keys = batch.column(ids).to_pylist()
        values = batch.column(text)
        start = size = 0
        own: list[bytes] = []
        for i in range(len(keys)):
            v = values[i]
            t = v.as_buffer().to_pybytes() if v.is_valid else b""
            if own and size + len(t) > CHUNK_BYTES:
                yield keys[start:i], own
                start, size, own = i, 0, []
            own.append(t)
            size += len(t)
        if own:
            yield keys[start:], own


def packed(docs: DataFrame, ids: str, text: str) -> DataFrame:
    """Rows (id, z): texts as zstd bytes, for shuffles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3)
        for keys, own in text_chunks(batches, "k", "t"):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([pack.compress(t) for t in own], pa.binary())], names=["id", "z"])

    rows = docs.select(F.col(ids).cast("bigint").alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, "id bigint, z binary")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads all bits of unsigned 64-bit values."""
    y = x >> np.uint64(31)
    y ^= x
    y *= np.uint64(0x9E3779B97F4A7C15)
    y ^= y >> np.uint64(29)
    y *= np.uint64(0xBF58476D1CE4E5B9)
    y ^= y >> np.uint64(32)
    return y


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of the links (a, b): rows (node, root), `root` being the least node.

    Distributed union-find by contraction. In each round a node hangs under its neighbour of least
    priority (a hash of its number, so that ordered chains shrink as fast as others), the links
    move up to the parents, and repeated links and loops go; the number of rounds is about the
    logarithm of the longest chain. Each round is written to the shared folder. Minima are combined
    before they are shuffled, and hubs meet their neighbours in joins that Spark can split.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").where("a <> b")
    links = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    steps: list[DataFrame] = []
    while not links.isEmpty():
        parent = cut(
            links.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("p"))
            .select("node", F.least(rank("node"), F.col("p"))["n"].alias("up")), f"{name}-up",
        )
        steps.append(parent)
        ends = links.join(parent.select(F.col("node").alias("a"), F.col("up").alias("pa")), "a")
        ends = ends.select("pa", "b").distinct().join(parent.select(F.col("node").alias("b"), F.col("up").alias("pb")), "b")
        above = cut(ends.where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), f"{name}-links")
        release(links)
        links = above
    if not steps:
        return spark.createDataFrame([], "node bigint, root bigint")
    found = steps[0].select("node", F.col("up").alias("top"))
    for step in steps[1:]:
        found = (
            found.join(step.select(F.col("node").alias("top"), F.col("up")), "top", "left")
            .select("node", F.coalesce("up", "top").alias("top"))
        )
    found = cut(found, f"{name}-top")
    least = found.groupBy("top").agg(F.min("node").alias("root"))
    out = cut(found.join(least, "top").select("node", "root"), f"{name}-components")
    release(found, links, *steps)
    return out
