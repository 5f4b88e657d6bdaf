"""Incident feature files and their date fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.functions.columns import epoch_ms_to_local_text

# Date fields of the incident layer.
DATE_FIELDS = (
    "FireDiscoveryDateTime",
    "ContainmentDateTime",
    "ControlDateTime",
    "CompletionDateTime",
    "CreatedOnDateTime_dt",
    "ModifiedOnDateTime_dt",
    "InitialResponseDateTime",
    "ICS209ReportDateTime",
    "FinalFireReportApprovedDate",
)


def scan_features(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature of JSON pages, its properties as columns."""
    pages = spark.read.option("multiLine", True).json(path)
    return pages.select(F.explode("features").alias("f")).select("f.properties.*")


def features_of(pages: DataFrame, text: str, properties: str) -> DataFrame:
    """The same for pages held as text, under declared property columns."""
    schema = f"features array<struct<properties: struct<{properties.replace(' ', ': ').replace(',: ', ', ')}>>>"
    return pages.select(F.explode(F.from_json(text, schema)["features"]).alias("f")).select("f.properties.*")


def format_dates(df: DataFrame, tz: str = "America/Los_Angeles") -> DataFrame:
    """Numeric epoch-millisecond date fields as local wall-clock text; text fields stay as they are."""
    numeric = {n for n, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double")}
    return df.withColumns({c: epoch_ms_to_local_text(F.col(c), tz) for c in DATE_FIELDS if c in numeric})
