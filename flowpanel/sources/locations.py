"""Meter metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowpanel.functions.ids import id_pad
from flowpanel.schemas import LOCATION_CSV


def clean_locations(raw: DataFrame) -> DataFrame:
    """Three columns, ids as zero-padded text, distinct rows."""
    return raw.select(
        id_pad("Meter_ID").alias("meter_id"),
        raw["Service_Point_Latitude"].alias("lat"),
        raw["Service_Point_Longitude"].alias("lon"),
    ).distinct()


def load_locations(spark: SparkSession, csv_path: str, table_path: str | None = None) -> DataFrame:
    """Read the metadata CSV; optionally overwrite a Parquet table with the result.

    The header names the columns, so a file with more columns or another order reads correctly.
    """
    raw = spark.read.option("header", True).csv(csv_path)
    typed = raw.select(*[raw[f.name].cast(f.dataType).alias(f.name) for f in LOCATION_CSV])
    locations = clean_locations(typed)
    if table_path:
        locations.write.mode("overwrite").parquet(table_path)
        return spark.read.parquet(table_path)
    return locations
