"""Outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.operators.polygons import ring_moments


def downcast(df: DataFrame) -> DataFrame:
    """Double columns as float."""
    return df.withColumns({n: F.col(n).cast("float") for n, t in df.dtypes if t == "double"})


def write_csv(df: DataFrame, path: str, *, missing: str = "", order: Sequence[str] = ()) -> None:
    """CSV with header; ``missing`` spells NULL, ``order`` sorts the output."""
    if order:
        df = df.orderBy(*order)
    df.write.mode("overwrite").option("header", True).option("nullValue", missing).option("emptyValue", "").csv(path)


def write_table(df: DataFrame, path: str, *, small: bool = False) -> None:
    """Parquet, or CSV when the path says so; ``small`` stores doubles as floats."""
    df = downcast(df) if small else df
    if path.lower().endswith(".csv"):
        write_csv(df, path, missing="NaN")
    else:
        df.write.mode("overwrite").parquet(path)


def write_by_year(df: DataFrame, path: str, date: str = "date") -> None:
    """One folder per year; reading ``path`` gives the merged table.

    Rows of a year meet in files of about the advisory size; a large year goes to many.
    """
    df.withColumn("year", F.year(date)).hint("rebalance", "year").write.mode("overwrite").partitionBy("year").parquet(path)


def write_by_day(df: DataFrame, path: str, date: str = "date") -> None:
    """One folder per input day; reading ``path`` gives the union of all days.  A day's rows meet before writing."""
    df.hint("rebalance", date).write.mode("overwrite").partitionBy(date).parquet(path)


def write_grid(cells: DataFrame, rings: DataFrame, folder: str) -> None:
    """Lookup table plus one GeoJSON feature per line.

    ``rings`` is (grid_id, ring) with one closed ring in degrees, or (grid_id, parts)
    with polygons of rings, as ``grid_geometry`` makes them.
    """
    cells.select("grid_id", "lon", "lat").write.mode("overwrite").parquet(f"{folder}/lookup")
    if "parts" not in rings.columns:
        rings = rings.where(ring_moments(F.col("ring"))["area"] > 0).select("grid_id", F.array(F.array("ring")).alias("parts"))
    pairs = F.transform("parts", lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.array(v["x"], v["y"]))))

    def feature(kind: str, coordinates: Column) -> Column:
        geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry")
        return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("grid_id").alias("properties"), geometry))

    line = F.when(F.size("parts") == 1, feature("Polygon", F.get("_pairs", F.lit(0)))).otherwise(feature("MultiPolygon", F.col("_pairs")))
    rings.withColumn("_pairs", pairs).select(line.alias("value")).write.mode("overwrite").text(f"{folder}/features")


def write_model(model: PipelineModel, record: DataFrame, folder: str) -> None:
    """Model, its record and its threshold."""
    model.write().overwrite().save(f"{folder}/model")
    record.write.mode("overwrite").json(f"{folder}/metadata")
    record.select(F.col("best_threshold").alias("threshold")).write.mode("overwrite").json(f"{folder}/threshold")


def write_report(report: DataFrame, violations: dict[str, DataFrame], folder: str) -> list[str]:
    """QA report, and the violating rows of every check that found some; returns those names."""
    write_csv(report, f"{folder}/summary")
    found = [name for name, rows in violations.items() if not rows.isEmpty()]
    for name in found:
        write_csv(violations[name], f"{folder}/{name}")
    return found
