"""Job parameters from a settings document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    start_date: str
    end_date: str
    bbox: tuple[float, float, float, float]  # lon_min, lat_min, lon_max, lat_max
    resolution_km: float
    crs_projected: str
    input_files: dict[str, str]


def read_settings(spark: SparkSession, path: str) -> Settings:
    schema = (
        "time_period struct<start_date: string, end_date: string>, "
        "spatial_extent struct<min_longitude: double, max_longitude: double, min_latitude: double, max_latitude: double>, "
        "grid struct<resolution_km: double, crs_projected: string>, input_files map<string, string>"
    )
    row = spark.read.schema(schema).json(path, multiLine=True).select("time_period.*", "spatial_extent.*", "grid.*", F.col("input_files")).first()
    if row is None or row.start_date is None or row.min_longitude is None:
        raise ValueError(f"no period or extent in {path}")
    return Settings(
        row.start_date,
        row.end_date,
        (row.min_longitude, row.min_latitude, row.max_longitude, row.max_latitude),
        row.resolution_km or 5.0,
        row.crs_projected or "EPSG:3310",
        dict(row.input_files or {}),
    )
